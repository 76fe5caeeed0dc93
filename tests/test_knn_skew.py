"""kNN on skewed points: exact, and few candidates per center whatever the crowd."""

import math
import random

import pytest

from deserta.functions.geo import haversine_py
from deserta.operators import knn as K


def _frames(spark, points, centers):
    p = spark.createDataFrame(points, "unique_id long, lat double, lon double")
    c = spark.createDataFrame(centers, "cid long, clat double, clon double")
    return c, p


def _crowd(n, seed):
    r = random.Random(seed)
    return [(i, 19.0 + r.random() * 0.05, 72.8 + r.random() * 0.05) for i in range(n)]


@pytest.mark.parametrize("far", [True, False])
def test_candidates_stay_few_and_results_exact(spark, monkeypatch, far):
    r = random.Random(7)
    points = _crowd(20000, 1) + ([] if far else [(20000 + i, r.uniform(8, 36), r.uniform(68, 97)) for i in range(3000)])
    points += [(90000 + i, 19.01, 72.81) for i in range(500)]  # equal coordinates
    centers = [(i, r.uniform(8, 36), r.uniform(68, 97)) for i in range(40)]
    centers += [(100 + i, 19.0 + r.random() * 0.05, 72.8 + r.random() * 0.05) for i in range(8)] + [(200, 19.01, 72.81)]
    seen = []
    joined = K.haversine_km

    def watched(frontier, *a, **more):
        out = before(frontier, *a, **more)
        seen.append(out)
        return out
    before = K._pruned
    monkeypatch.setattr(K, "_pruned", watched)
    c, p = _frames(spark, points, centers)
    got = {}
    for x in K.knn_join(c, ["cid"], "clat", "clon", p, "lat", "lon", k=3).collect():
        got.setdefault(x["cid"], []).append((x["rank"], x["unique_id"]))
    for cid, la, lo in centers:
        want = sorted((haversine_py(a, b, la, lo), i) for i, a, b in points)[:3]
        mine = [i for _, i in sorted(got[cid])]
        near = {i: (a, b) for i, a, b in points if i in mine}
        assert [round(haversine_py(*near[i], la, lo), 6) for i in mine] == [round(d, 6) for d, _ in want]
    assert sorted(i for _, i in got[200]) == [90000, 90001, 90002]
    per_center = seen[-1].groupBy("cid").count().agg({"count": "max"}).first()[0]
    assert per_center <= 60 * 3 and joined is K.haversine_km and math.isfinite(per_center)


def test_few_points_and_poles(spark):
    points = [(1, 90.0, 10.0), (2, -90.0, 180.0), (3, 0.0, 180.0), (4, 0.0, -180.0), (5, float("nan"), 0.0)]
    c, p = _frames(spark, points, [(1, 89.9, -170.0), (2, 0.0, 179.99), (3, None, 1.0)])
    got = sorted((x["cid"], x["rank"], x["unique_id"]) for x in K.knn_join(c, ["cid"], "clat", "clon", p, "lat", "lon", k=2).collect())
    assert got == [(1, 1, 1), (1, 2, 3), (2, 1, 3), (2, 2, 4)]
