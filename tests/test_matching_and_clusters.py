"""Ordered matching, components, proximity clusters and numbering against sequential brute force."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from deserta.operators import clusters
from deserta.operators.components import connected_components
from deserta.operators.matching import ordered_matches
from deserta.operators.numbering import numbered
from deserta.operators.polygon import point_in_polygon_join

FEW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


def walk(pairs):
    """Takers one by one, each its best free item."""
    used, out = set(), {}
    for taker in sorted({t for t, _, _ in pairs}):
        free = [(r, i) for t, i, r in pairs if t == taker and i not in used]
        if free:
            out[taker] = min(free)[1]
            used.add(out[taker])
    return out


@FEW
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25), st.integers(0, 6)), max_size=220))
def test_ordered_matches_equal_the_walk(spark, pairs):
    df = spark.createDataFrame(pairs + [(None, 3, 1), (3, None, 1)], "b long, p long, r int")
    assert {r["b"]: r["p"] for r in ordered_matches(df, "b", "p", "r").collect()} == walk(pairs)


def test_a_chain_of_overlaps_settles(spark):
    """Every taker prefers the item of the one before it, which only the walk's order decides."""
    pairs = [(t, t + d, r) for t in range(12) for d, r in ((0, 0), (1, 1))] + [(t, t - 1, -1) for t in range(1, 12)]
    df = spark.createDataFrame(pairs, "b long, p long, r int")
    assert {r["b"]: r["p"] for r in ordered_matches(df, "b", "p", "r").collect()} == walk(pairs)


def test_takers_that_all_want_the_same_items_go_in_blocks(spark):
    """60 takers with one ranking of 60 items would be 60 rounds; blocks of 25 and 1,000 takers need far fewer jobs."""
    pairs = [(t, i, (i * 37 % 60) // 2) for t in range(60) for i in range(60) if (t * 7 + i) % 11]
    df = spark.createDataFrame(pairs, "b long, p long, r int")
    for block in (25, 1000):
        spark.sparkContext.setJobGroup(f"block {block}", "")
        assert {r["b"]: r["p"] for r in ordered_matches(df, "b", "p", "r", block).collect()} == walk(pairs)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"block {block}")
        assert len(jobs) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_later_boundary_gets_the_point_that_an_earlier_one_did_not_need(spark):
    squares = [(i, float(x), float(y), h) for i, (x, y, h) in enumerate(
        (x, y, h) for x in range(0, 6, 2) for y in range(0, 6, 2) for h in (2.5, 1.6))]
    points = [(f"p{i}", (i * 37 % 80) / 10, (i * 53 % 80) / 10, i * 7 % 5) for i in range(40)]
    b = spark.createDataFrame(squares, "feature_index long, x double, y double, h double").select(
        "feature_index", F.array(F.array(F.array(
            *[F.array(F.col("x") + F.col("h") * a, F.col("y") + F.col("h") * c)
              for a, c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))).alias("geometry"))
    p = spark.createDataFrame(points, "key string, longitude double, latitude double, r int")
    got = {r["feature_index"]: r["key"] for r in point_in_polygon_join(b, p, "key", F.struct("r", "key")).collect()}
    inside = [(i, k, (r, k)) for i, x, y, h in squares for k, px, py, r in points if abs(px - x) < h and abs(py - y) < h]
    lowest = {min(i for i, k2, _ in inside if k2 == k) for _, k, _ in inside}  # boundaries that are some point's lowest one
    assert got == walk(inside) and len(got) > len(lowest)


def groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@FEW
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=90))
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == groups(edges)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == groups(edges)


def clusters_by_hand(points, zoom):
    world = 512 * 2.0 ** zoom
    members = {i: [i] for i, *_ in points}
    data = {i: (lon, lat, impact) for i, lon, lat, impact in points}

    def circle(ids):
        impact = sum(data[i][2] for i in ids)
        w = [max(data[i][2], 1) for i in ids]
        lon = sum(data[i][0] * x for i, x in zip(ids, w)) / sum(w)
        lat = sum(data[i][1] * x for i, x in zip(ids, w)) / sum(w)
        s = math.sin(math.radians(max(-85.05113, min(85.05113, lat))))
        return ((lon + 180) / 360 * world, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * world,
                max(7, min(26, 6 + math.sqrt(max(impact, 1)) * 0.05)))

    def merge(edges):
        nonlocal members
        named = groups(edges)
        out = {}
        for c, ids in members.items():
            out.setdefault(named.get(c, c), []).extend(ids)
        members = out

    while True:
        at = {c: circle(ids) for c, ids in members.items()}
        cells = {}
        for c, (x, y, _) in at.items():
            cells.setdefault((x // clusters.CELL, y // clusters.CELL), []).append(c)
        same = [(min(cs), c) for cs in cells.values() for c in cs if c != min(cs)]
        if same:
            merge(same)
            continue
        near = [(a, b) for a in at for b in at if a < b
                and math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) <= at[a][2] + at[b][2] + 2]
        if not near:
            return {i: c for c, ids in members.items() for i in ids}
        merge(near)


@pytest.mark.parametrize("seed, spread", [(1, 25.0), (2, 6.0), (3, 1.0)])
def test_proximity_clusters_equal_brute_force(spark, seed, spread):
    import random

    r = random.Random(seed)
    points = [(f"i{j:03}", r.uniform(70, 70 + spread), r.uniform(10, 10 + spread), float(r.choice([0, 5, 400, 90000, 400000])))
              for j in range(150)]
    df = spark.createDataFrame(points, "id string, longitude double, latitude double, population_impact double")
    got = {x["id"]: x["cluster_key"] for x in clusters.proximity_clusters(df).collect()}
    want = clusters_by_hand(points, 4.0)
    assert got == want and (spread > 1 or len(set(want.values())) == 1)


def test_points_a_pixel_apart_merge_across_a_cell_edge(spark):
    px = 360 / (512 * 16)
    edge = -180 + 64 * 30 * px  # an edge of the 64 pixel grid
    rows = [("a", edge - px / 2, 0.0, 1.0), ("b", edge + px / 2, 0.0, 1.0), ("c", edge + 40 * px, 0.0, 1.0), (None, 1.0, 1.0, 1.0),
            ("d", None, 1.0, 1.0), ("e", float("nan"), 1.0, 1.0), ("c", edge + 40 * px, 0.0, None)]
    df = spark.createDataFrame(rows, "id string, longitude double, latitude double, population_impact double")
    assert {r["id"]: r["cluster_key"] for r in clusters.proximity_clusters(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert clusters.proximity_clusters(df.limit(0)).count() == 0


def test_a_dense_place_makes_no_pairs(spark):
    """5,000 circles of one city merge by cells: the equi-join sees one circle per cell."""
    df = spark.range(5000).selectExpr("concat('p', id) AS id", "77 + (id % 100) / 1e4 AS longitude", "28 + id / 1e6 AS latitude",
                                      "1.0D AS population_impact")
    assert clusters.proximity_clusters(df).select("cluster_key").distinct().count() == 1


def test_numbers_equal_the_global_window_without_one_task(spark):
    df = spark.range(5000).selectExpr("cast(id * 7919 % 5000 AS int) AS k", "id % 3 AS v").repartition(7)
    out = numbered(df, [F.col("k").desc()], partitions=6)
    assert "Window" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert {r["k"]: r["row_number"] for r in rows} == {k: 5000 - k for k in range(5000)}
    assert numbered(df.limit(0), [F.col("k")]).count() == 0
    few = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3)], "k string, v int")
    assert {r["v"]: r["row_number"] for r in numbered(few, [F.col("k").asc_nulls_last()]).collect()} == {3: 1, 2: 2, 1: 3}


def test_large_boundaries_meet_the_points_in_layers(spark, monkeypatch):
    """Overlapping boundaries over many points: the pairs that are made are a part of all, and the match is the walk's."""
    import random

    from deserta.operators import polygon

    monkeypatch.setattr(polygon, "PAIRS", 0)
    monkeypatch.setattr(polygon, "LAYER", 25)
    rng = random.Random(4)
    squares = [(rng.randrange(10_000), rng.uniform(0, 12), rng.uniform(0, 12), rng.choice([.2, 2.5, 2.5, 2.5])) for _ in range(40)]
    squares += [(squares[0][0], 3.0, 9.0, 2.0), (None, 5.0, 5.0, 3.0), (20_000, 50.0, 50.0, 1.0), (20_001, None, 1.0, 1.0)]  # an index twice, none, far off
    points = [(f"p{i % 190}", rng.uniform(0, 12), rng.uniform(0, 12), rng.randrange(9)) for i in range(200)]  # ten keys come twice
    points += [(None, 5.0, 5.0, 0), ("q", None, 5.0, 0), ("q", 5.0, None, 0)]
    b = spark.createDataFrame(squares, "feature_index long, x double, y double, h double").select(
        "feature_index", F.array(F.array(F.array(*[F.array(F.col("x") + F.col("h") * a, F.col("y") + F.col("h") * c)
                                                   for a, c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]))).alias("geometry"))
    b = b.withColumn("geometry", F.when(F.expr("geometry[0][0][0][0] IS NOT NULL"), F.col("geometry")))
    p = spark.createDataFrame(points, "key string, longitude double, latitude double, r int")
    made, candidates = [], polygon.polygon_candidates
    monkeypatch.setattr(polygon, "polygon_candidates", lambda *a: made.append(candidates(*a)) or made[-1])
    got = [(r["feature_index"], r["key"]) for r in point_in_polygon_join(b, p, "key", F.struct("r", "key")).collect()]
    inside = [(i, k, (r, k)) for i, x, y, h in squares for k, px, py, r in points
              if None not in (i, k, x, px, py) and abs(px - x) < h and abs(py - y) < h]
    assert dict(got) == walk(inside) and len(got) == len(dict(got)) > 30
    assert len(made) > 2
    assert point_in_polygon_join(b, p.limit(0), "key", F.struct("r", "key")).count() == point_in_polygon_join(b.limit(0), p, "key", F.struct("r", "key")).count() == 0


def test_the_estimate_of_pairs_follows_the_boxes(spark):
    from deserta.operators.polygon import estimated_pairs, square

    b = spark.range(40).select((F.col("id") % 7).alias("feature_index"), F.array(F.array(square(F.col("id") / 9 + 2, F.lit(5.0), 2.0))).alias("geometry"))
    p = spark.range(900).selectExpr("id % 30 / 3D + 0.1 AS longitude", "id div 30 / 3D + 0.1 AS latitude")
    true = sum(abs(i % 30 / 3 + .1 - j / 9 - 2) < 2 and abs(i // 30 / 3 + .1 - 5) < 2 for i in range(900) for j in range(40))
    assert 0.8 * true < estimated_pairs(b, p, 1.0) < 1.2 * true
    assert estimated_pairs(b.limit(0), p, 1.0) == 0
