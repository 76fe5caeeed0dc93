"""Sums within distances equal those of the pairs, and neither they nor kNN meet rows by the pair."""

import random

from deserta.functions.geo import haversine_py
from deserta.operators import knn as K, range_count as R
from deserta.plans import queries as Q, serving as SV
from conftest import SF001, assert_same


def _inputs():
    r = random.Random(3)
    points = [(19.0 + r.random() * 0.4, 72.8 + r.random() * 0.4) for _ in range(3000)]
    points += [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(600)] + [(19.01, 72.81)] * 400
    points += [(r.uniform(-2, 2), s * (180 - r.random())) for s in (1, -1) for _ in range(100)]
    points += [(s * (90 - r.random()), r.uniform(-180, 180)) for s in (1, -1) for _ in range(60)] + [(90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    centers = [(19.2 + r.uniform(-2, 2), 73 + r.uniform(-2, 2)) for _ in range(25)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(15)]
    centers += [(19.01, 72.81), (0.0, 180.0), (0.5, -179.9), (89.5, 10.0), (-90.0, 0.0), (90.0, 5.0)]
    return points, centers


def test_sums_are_those_of_the_pairs(spark):
    points, centers = _inputs()
    rows = [(a, b, 1, i % 3) for i, (a, b) in enumerate(points)] + [(None, 1.0, 1, 1), (float("nan"), 1.0, 1, 1)]
    p = spark.createDataFrame(rows, "lat double, lon double, one long, w long")
    c = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(centers)] + [(900, None, 1.0)], "cid long, clat double, clon double")
    for radii in ({"s": 5.0, "m": 30.0, "l": 160.0}, {"world": 15000.0}):
        got = {x["cid"]: x for x in R.within_distance_sums(p, "lat", "lon", ["one", "w"], c, "cid", "clat", "clon", radii, 6371.0).collect()}
        for cid, (la, lo) in enumerate(centers):
            d = [haversine_py(a, b, la, lo, 6371.0) for a, b in points]
            for name, radius in radii.items():
                near = [i for i, x in enumerate(d) if x <= radius]
                want = (len(near), sum(i % 3 for i in near))
                assert ((got[cid][f"one_{name}"], got[cid][f"w_{name}"]) if cid in got else (0, 0)) == want, (cid, name)
        assert 900 not in got and all(x[f"one_{max(radii, key=radii.get)}"] > 0 for x in got.values())
    none = R.within_distance_sums(p.where("false"), "lat", "lon", ["one"], c, "cid", "clat", "clon", {"r": 10.0})
    assert none.columns == ["cid", "one_r"] and none.count() == 0


def test_serving_makes_no_links(spark, monkeypatch):
    want = SV.district_geo(Q.distance_table(spark, SF001)).toPandas()
    monkeypatch.setattr("deserta.plans.distances.within_distance_join", None)
    assert_same(Q.serving_inputs(spark, SF001)["geo"], want)


def test_centers_of_a_cell_share_a_frontier(spark, monkeypatch):
    r = random.Random(9)
    points = [(i, r.uniform(8, 36), r.uniform(68, 97)) for i in range(4000)]
    c = spark.createDataFrame([(i, 20.0 + i * 1e-6, 80.0) for i in range(1000)], "cid long, clat double, clon double")
    written, write = [], K._checkpoint
    monkeypatch.setattr(K, "_checkpoint", lambda df: written.append(write(df)) or written[-1])
    got = K.knn_join(c, ["cid"], "clat", "clon", spark.createDataFrame(points, "unique_id long, lat double, lon double"), "lat", "lon", k=3)
    best = sorted((haversine_py(a, b, 20.0, 80.0), i) for i, a, b in points)[:3]
    assert [x["unique_id"] for x in got.where("cid = 0").orderBy("rank").collect()] == [i for _, i in best] and got.count() == 3000
    assert sum(df.count() for df in written if "leaf" in df.columns and "_bound" in df.columns) < 1000
