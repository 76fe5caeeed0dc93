"""Thinning of whole link lists against the walk, one place after the other."""

import random

from deserta.functions.geo import haversine_py
from deserta.operators.thinning import thin_links

SCHEMA = "grp string, km double, id long, lat double, lon double"


def walk(rows, min_km):
    kept = []
    for r in sorted(set(r for r in rows if r[3] is not None and r[4] is not None), key=lambda r: (r[0] or "", r[1:])):
        if all(k[0] != r[0] or haversine_py(k[3], k[4], r[3], r[4]) >= min_km for k in kept):
            kept.append(r)
    return sorted(kept + [r for r in rows if r[3] is None or r[4] is None], key=str)


def thinned(spark, rows, min_km):
    return sorted(map(tuple, thin_links(spark.createDataFrame(rows, SCHEMA), ["grp"], ["km", "id"], "lat", "lon", min_km).collect()), key=str)


def around(rng, grp, n, lat, lon, spread, first=0):
    places = [(lat + rng.gauss(0, spread), (lon + rng.gauss(0, spread) + 180) % 360 - 180) for _ in range(n)]
    return [(grp, haversine_py(lat, lon, a, b), first + i, a, b) for i, (a, b) in enumerate(places)]


def test_thinning_equals_the_walk(spark):
    """Many places in one district, others across the date line and near a pole, and a null group."""
    rng = random.Random(7)
    min_km = 3.0
    rows = (around(rng, "dense", 1500, 20.0, 78.0, 0.025) + around(rng, "date line", 200, -17.0, 179.99, 0.05)
            + around(rng, "pole", 40, 88.0, 10.0, 0.1) + around(rng, None, 100, 20.0, 78.0, 0.05))
    assert thinned(spark, rows, min_km) == walk(rows, min_km)


def test_thinning_of_hard_rows(spark):
    """Equal places, ties in distance, repeated rows, no coordinates, nothing to thin and an empty table."""
    rows = [("a", 1.0, 2, 10.0, 10.0), ("a", 1.0, 1, 10.0, 10.0), ("a", 1.0, 1, 10.0, 10.0), ("b", 1.0, 1, 10.0, 10.0),
            ("a", 2.0, 3, 10.0, 10.5), ("a", 2.5, 4, None, 10.5), ("a", 2.5, 4, None, 10.5), ("a", 3.0, 5, 10.0, 10.51)]
    assert thinned(spark, rows, 3.0) == walk(rows, 3.0) == sorted(
        [rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)
    assert thinned(spark, rows, 0.0) == sorted(rows, key=str)
    assert thinned(spark, [], 3.0) == []


def test_one_crowded_place_makes_no_pairs(spark):
    """5,000 facilities of one town: no list gathered and no join of places with places."""
    rng = random.Random(3)
    rows = around(rng, "town", 5_000, 20.0, 78.0, 0.004)
    df = thin_links(spark.createDataFrame(rows, SCHEMA), ["grp"], ["km", "id"], "lat", "lon", 3.0)
    assert [r["id"] for r in df.collect()] == [min(rows, key=lambda r: (r[1], r[2]))[2]]


def test_kept_places_are_not_broadcast(spark, monkeypatch):
    """A kept place stands in dozens of cells: its file is small and its rows are not."""
    from deserta.operators import thinning

    plans, write = [], thinning.checkpoint_table

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(thinning, "checkpoint_table", seen)
    rows = around(random.Random(5), "a", 60, 20.0, 78.0, 0.05)
    assert thinned(spark, rows, 3.0) == walk(rows, 3.0)
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def within(spark, points, centers, radius, min_km):
    from deserta.operators.thinning import thin_within

    return thin_within(spark.createDataFrame(points, "id long, name string, lat double, lon double"), ["id"], "lat", "lon",
                       spark.createDataFrame(centers, "grp string, clat double, clon double"), "clat", "clon", radius, min_km, distance_col="km")


def walk_within(points, centers, radius, min_km):
    out = []
    for g, a, b in centers:
        if a is None:
            continue
        near = sorted({(haversine_py(p[2], p[3], a, b), p[0] if p[0] is not None else -1, p[2], p[3], p[1]) for p in points if p[2] is not None and p[3] is not None})
        kept = []
        for r in near:
            if r[0] <= radius and all(haversine_py(k[2], k[3], r[2], r[3]) >= min_km for k in kept):
                kept.append(r)
        out += [(g, r[1], r[4]) for r in kept]
    return sorted(out, key=str)


def test_links_thinned_where_they_are_made_equal_the_walk(spark, monkeypatch):
    """Dense and sparse places, the date line, a pole, equal coordinates, equal distances, null coordinates and keys, repeated rows."""
    from deserta.operators import thinning

    monkeypatch.setattr(thinning, "SALTED", 40)
    rng = random.Random(11)
    at = ([(20 + rng.gauss(0, .8), 78 + rng.gauss(0, .8)) for _ in range(900)] + [(20.1 + rng.gauss(0, .01), 78.1 + rng.gauss(0, .01)) for _ in range(400)]
          + [(-17 + rng.gauss(0, .5), (179.9 + rng.gauss(0, .9) + 180) % 360 - 180) for _ in range(200)] + [(88 + rng.random() * 2, rng.uniform(-180, 180)) for _ in range(150)]
          + [(50.0 + x * .25, 10.0 + y * .5) for x in range(-4, 5) for y in range(-4, 5)] + [(90.0, 5.0), (-90.0, 7.0), (20.0, 78.0)])
    points = [(i, f"n{i % 7}", a, b) for i, (a, b) in enumerate(at)]
    points += [(5000 - i, "m", 20.0, 78.0) for i in range(9)] + [(3, "x", None, 1.0), (4, "x", 1.0, None), (None, "y", 50.0, 10.0), points[5], points[5]]
    centers = [("a", 20.0, 78.0), ("b", 20.5, 78.4), ("c", -17.0, 179.99), ("d", -17.2, -179.6), ("e", 89.5, 0.0), ("f", 50.0, 10.0), (None, 50.25, 10.5),
               ("g", None, 1.0), ("h", 0.0, 0.0), ("i", -90.0, 0.0)]
    for radius, min_km in ((160.0, 45.0),):
        got = sorted(((r["grp"], r["id"] if r["id"] is not None else -1, r["name"]) for r in within(spark, points, centers, radius, min_km).collect()), key=str)
        assert got == walk_within(points, centers, radius, min_km) and len(got) > 20
    assert within(spark, [], centers, 160.0, 60.0).count() == within(spark, points, [], 160.0, 60.0).count() == 0


def test_links_are_not_written_for_thinning(spark, monkeypatch):
    """2,000 places within reach of 40 districts are 80,000 links; what is written grows with the districts' cells."""
    from deserta.operators import thinning

    sizes, write = [], thinning.checkpoint_table

    def seen(df, name="table"):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(thinning, "checkpoint_table", seen)
    rng = random.Random(2)
    points = [(i, "n", 20 + rng.gauss(0, .3), 78 + rng.gauss(0, .3)) for i in range(2000)]
    centers = [(f"d{i}", 20 + rng.gauss(0, .1), 78 + rng.gauss(0, .1)) for i in range(40)]
    assert within(spark, points, centers, 160.0, 60.0).count() > 40
    assert max(sizes) < 8_000
