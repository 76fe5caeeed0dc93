"""The distance join on one dense city: exact, no join key with many points, centers only where they can reach."""

import random

import pytest
from pyspark.sql import functions as F

from deserta.functions.geo import haversine_py
from deserta.operators import distance_join as J

POINT, CENTER = "unique_id long, svc string, lat double, lon double", "cid long, svc string, clat double, clon double"


def _inputs(seed=5):
    r = random.Random(seed)
    points = [(i, "ab"[i % 2], 19.0 + r.random() * 0.4, 72.8 + r.random() * 0.4) for i in range(4000)]
    points += [(5000 + i, "a", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(800)]
    points += [(6000 + i, "a", 19.01, 72.81) for i in range(900)]  # equal coordinates
    points += [(7000 + i, "b", r.uniform(-2, 2), 180.0 - i * 1e-3) for i in range(150)]  # dense at the date line
    points += [(7500 + i, "b", r.uniform(-2, 2), -180.0 + i * 1e-3) for i in range(150)]
    points += [(8000 + i, "a", 90.0 - r.random(), r.uniform(-180, 180)) for i in range(100)] + [(9000, "a", 90.0, 0.0),
               (9001, "a", -90.0, 180.0), (9002, "a", None, 1.0)]
    centers = [(i, "ab"[i % 2], 19.2 + r.uniform(-2, 2), 73.0 + r.uniform(-2, 2)) for i in range(30)]
    centers += [(100 + i, "ab"[i % 2], r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(20)]
    centers += [(200, "b", 0.0, 179.9), (201, "b", 0.5, -179.9), (202, "a", 89.5, 10.0), (203, "a", -89.9, 0.0), (204, "a", None, 1.0)]
    return points, centers


@pytest.mark.parametrize("keyed", [False, True])
def test_split_join_is_exact(spark, keyed):
    points, centers = _inputs()
    p, c = spark.createDataFrame(points, POINT), spark.createDataFrame(centers, CENTER)
    c = c if keyed else c.drop("svc")
    got = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", 160.0, keys=["svc"] if keyed else None, dense_cell=50)
    assert got.columns.count("svc") == 1 and not [x for x in got.columns if x.startswith("_")]
    pairs = sorted((x["unique_id"], x["cid"]) for x in got.select("unique_id", "cid").collect())
    want = sorted((i, k) for i, s, a, b in points for k, t, la, lo in centers
                  if a is not None and la is not None and (not keyed or s == t) and haversine_py(a, b, la, lo) <= 160.0)
    assert pairs == want and len(want) > 10000


def test_no_key_is_hot_and_centers_meet_near_cells_only(spark):
    points, centers = _inputs()
    points += [(20000 + i, "a", 19.0 + i * 1e-5, 72.8) for i in range(3000)]
    cell, ncols = J.grid_spec(160.0, 6371.0)
    p = spark.createDataFrame(points, POINT).where("lat IS NOT NULL")
    fi, fj = J.point_cell(F.col("lat"), F.col("lon"), cell / J.FINE, ncols * J.FINE)
    p = p.withColumns({"_fi": fi, "_fj": fj}).withColumns({"_ci": F.floor(F.col("_fi") / J.FINE), "_cj": F.floor(F.col("_fj") / J.FINE)})
    plain = p.groupBy("_ci", "_cj").count().agg(F.max("count")).first()[0]
    small = J._counted(p, [], 50)
    key = ["_ci", "_cj", "_fi", "_fj", "_salt"]
    split = J.split_points(p, small, [])
    assert split.count() == p.count()
    assert plain > 4000 and split.groupBy(*key).count().agg(F.max("count")).first()[0] <= 150
    c = spark.createDataFrame(centers, CENTER).where("clat IS NOT NULL")
    c = c.withColumn("_cell", F.explode(J.cap_cells(F.col("clat"), F.col("clon"), 160.0, 6371.0, cell, ncols))).select(
        "cid", "clat", "clon", F.col("_cell.i").alias("_ci"), F.col("_cell.j").alias("_cj"))
    placed = J.split_centers(c, small, [], "clat", "clon", 160.0, 6371.0, cell / J.FINE)
    met = split.join(placed, key).groupBy("cid").count()
    all_met = p.join(c, ["_ci", "_cj"]).groupBy("cid").count()
    assert met.agg(F.sum("count")).first()[0] < 0.9 * all_met.agg(F.sum("count")).first()[0]


def test_nothing_dense_keeps_the_plain_plan_and_empty_inputs_work(spark):
    points, centers = _inputs()
    p, c = spark.createDataFrame(points, POINT), spark.createDataFrame(centers, CENTER).drop("svc")
    plain = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", 160.0)
    same = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", 160.0, dense_cell=10 ** 6)
    assert sorted(plain.columns) == sorted(same.columns) and plain.count() == same.count()
    assert J.within_distance_join(p.where("false"), "lat", "lon", c, "clat", "clon", 160.0, dense_cell=50).count() == 0
    assert J.within_distance_join(p, "lat", "lon", c.where("false"), "clat", "clon", 160.0, dense_cell=50).count() == 0


def test_a_low_bound_makes_no_salts(spark, monkeypatch):
    """Each salt is a copy of every center within reach."""
    r = random.Random(11)
    points = [(i, "a", 19.0 + r.random() * 0.4, 72.8 + r.random() * 0.4) for i in range(4000)]
    seen, split = [], J.split_centers
    monkeypatch.setattr(J, "split_centers", lambda *a, **k: seen.append(split(*a, **k)) or seen[-1])
    p = spark.createDataFrame(points, POINT)
    c = spark.createDataFrame([(i, "a", 19.2, 73.0 + i / 100) for i in range(20)], CENTER).drop("svc")
    got = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", 30.0, dense_cell=20)
    want = sum(haversine_py(a, b, 19.2, 73.0 + i / 100) <= 30.0 for _, _, a, b in points for i in range(20))
    assert got.count() == want > 10000
    assert seen[0].agg(F.max("_salt")).first()[0] == 0
