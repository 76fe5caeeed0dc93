"""Boundary, property and adversarial tests for the operators."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from deserta.functions import risk as R
from deserta.functions.cleaning import (clean_survey_number, coerce_number, coerce_string, list_preview,
                                        normalize_key, short_label, snake_label)
from deserta.functions.geo import haversine_py


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("v")).collect()]


def test_clean_survey_number(spark):
    vals = ["12.3", "(12.3)", "( 12.3 )", "*", " * ", "NA", "", None, " 1 2 ", "(*)"]
    out = _one(spark, [(v,) for v in vals], "x string", clean_survey_number("x"))
    assert out == [12.3, 12.3, 12.3, None, None, None, None, None, 12.0, None]


def test_key_normalisation_modes(spark):
    rows = [("  Pune ",), ("\tpune",), (None,)]
    assert _one(spark, rows, "x string", normalize_key("x", "upper")) == ["PUNE", "\tPUNE", None]
    assert _one(spark, rows, "x string", normalize_key("x", "trim")) == ["Pune", "\tpune", None]
    assert _one(spark, rows, "x string", normalize_key("x", "js")) == ["Pune", "pune", None]
    assert _one(spark, rows, "x string", coerce_string("x")) == ["Pune", "pune", ""]


def test_coerce_number(spark):
    rows = [("1.5",), (" 2 ",), ("NaN",), ("Infinity",), ("abc",), ("",), (None,)]
    assert _one(spark, rows, "x string", coerce_number("x")) == [1.5, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert _one(spark, rows, "x string", coerce_number("x", None)) == [1.5, 2.0, None, None, None, None, None]


@pytest.mark.parametrize("cat,hi,med,direction", [("diabetes", 15, 10, "up"), ("hypertension", 20, 15, "up"),
                                                  ("nutrition", 25, 20, "up"), ("cancer", 30, 50, "down")])
def test_threshold_boundaries(spark, cat, hi, med, direction):
    eps = 1e-9
    hi, med = float(hi), float(med)
    vals = [hi, hi + eps, hi - eps, med, med + eps, med - eps, None, float("nan")]
    out = _one(spark, [(v,) for v in vals], "x double", R.category_risk(cat, "x"))
    if direction == "up":
        assert out == ["Medium Risk", "High Risk", "Medium Risk", "Low Risk", "Medium Risk", "Low Risk", "Unknown",
                       "High Risk"]
    else:
        assert out == ["Medium Risk", "Medium Risk", "High Risk", "Low Risk", "Low Risk", "Medium Risk", "Unknown",
                       "Low Risk"]


def test_maternal_three_valued_logic(spark):
    # NULL C-section never fires but does not block; a good score with NULL C-section is Low Risk.
    rows = [(95.0, 93.0, None), (95.0, 93.0, 9.0), (60.0, 60.0, None), (None, 93.0, 18.0), (90.0, 88.0, 12.0)]
    out = _one(spark, rows, "i double, s double, c double", R.maternal_risk("i", "s", "c"))
    assert out == ["Low Risk", "High Risk", "High Risk", "Unknown", "Medium Risk"]
    flags = _one(spark, [(None,), (9.99,), (10.0,), (14.99,), (15.0,), (20.0,), (20.01,)], "c double",
                 R.csection_access_flag("c"))
    assert flags == ["Unknown", "Potentially Limited Access", "Monitor Access", "Monitor Access", "Expected Range",
                     "Expected Range", "Elevated Utilization"]


def test_overall_is_worst(spark):
    labels = ["High Risk", "Medium Risk", "Unknown", "Low Risk"]
    rows = [(a, b) for a in labels for b in labels]
    out = _one(spark, rows, "a string, b string", R.overall_risk(F.col("a"), F.col("b")))
    order = {lab: i for i, lab in enumerate(labels)}
    for (a, b), o in zip(rows, out):
        assert o == labels[min(order[a], order[b])]


def test_display_labels(spark):
    assert _one(spark, [("not_capable",), (None,), ("",)], "x string", snake_label("x")) == [
        "Not Capable", "Unknown", "Unknown"]
    assert _one(spark, [("  A   very  long facility name that goes on ",)], "x string", short_label("x")) == [
        "A very long facility name..."]
    assert _one(spark, [('["a","b","c","d"]',), ("plain",), (None,)], "x string", list_preview("x", 2)) == [
        "a, b", "plain", ""]


def _cross_join_distances(facilities, centers, radius_km=160.0):
    """Brute-force reference for the grid join (test only): every facility against every center."""
    from deserta.functions.geo import ETL_RADIUS_KM, haversine_km
    from deserta.plans.distances import facility_points

    return (facility_points(facilities).crossJoin(centers)
            .withColumn("distance_kilometers", haversine_km("facility_latitude", "facility_longitude",
                                                             "center_latitude", "center_longitude", ETL_RADIUS_KM))
            .filter(F.col("distance_kilometers") <= radius_km))


def test_grid_join_equals_cross_join(spark):
    from deserta.plans import queries as Q
    from deserta.sources import fixtures as FX

    grid = Q.distance_table(spark, SF01).select("unique_id", "district")
    cross = _cross_join_distances(FX.facilities(spark, SF01), Q.centers(spark, SF01)).select("unique_id", "district")
    assert grid.count() == 1635
    assert grid.exceptAll(cross).count() == 0 and cross.exceptAll(grid).count() == 0


def test_grid_join_wraps_antimeridian_and_poles(spark):
    from deserta.operators.distance_join import within_distance_join

    pts = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 89.95, 10.0), (4, 89.95, -170.0),
                                 (5, -45.0, 0.0)], "pid int, lat double, lon double")
    ctr = spark.createDataFrame([("a", 0.0, 180.0), ("b", 89.99, 100.0), ("c", -45.0, 1.0)],
                                "cid string, clat double, clon double")
    got = {(r.pid, r.cid) for r in within_distance_join(pts, "lat", "lon", ctr, "clat", "clon", 50.0).collect()}
    want = {(p, c) for p, la, lo in pts.collect() for c, cla, clo in ctr.collect()
            if haversine_py(la, lo, cla, clo) <= 50.0}
    assert got == want and (1, "a") in got and (2, "a") in got and (4, "b") in got


def test_knn_equals_brute_force(spark):
    from deserta.plans import queries as Q
    from deserta.plans import serving as SV

    p = Q.serving_inputs(spark, SF001)
    located = SV.attach_capability(p["loc"], p["cap"])
    got = {(r.district_key, r.service, r.rank): (r.unique_id, round(r.distance_kilometers, 6))
           for r in SV.knn_capable_long(p["geo"], located, k=3).collect()}
    pts = SV.capable_services(located).collect()
    want = {}
    for g in p["geo"].collect():
        for s in SV.SERVICES:
            cand = sorted((haversine_py(f.facility_latitude, f.facility_longitude, g.latitude, g.longitude), f.unique_id)
                          for f in pts if f.service == s)
            for i, (d, uid) in enumerate(cand[:3]):
                want[(g.district_key, s, i + 1)] = (uid, round(d, 6))
    assert got == want


def test_point_in_polygon(spark):
    from deserta.operators.polygon import in_multipolygon

    shell = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]
    far = [[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 11.0]]
    geom = [[shell, hole], [far]]
    rows = [(0.5, 0.5), (2.0, 2.0), (10.5, 10.5), (5.0, 5.0), (0.0, 2.0), (4.0, 2.0)]
    df = spark.createDataFrame([(x, y, geom) for x, y in rows],
                               "x double, y double, g array<array<array<array<double>>>>")
    out = [r[0] for r in df.select(in_multipolygon(F.col("x"), F.col("y"), F.col("g"))).collect()]
    # even-odd: left edge is inside, right edge is outside (the half-open ray rule)
    assert out == [True, False, True, False, True, False]


def test_spatial_thin_keeps_far_apart(spark):
    from deserta.plans import console as CO
    from deserta.plans import queries as Q

    thinned = CO.thin_nearest(Q.nearest(spark, SF001)).collect()
    by_group = {}
    for r in thinned:
        by_group.setdefault((r.district_key, r.category), []).append(r)
    for rows in by_group.values():
        for i, a in enumerate(rows):
            for b in rows[i + 1:]:
                assert haversine_py(a.facility_latitude, a.facility_longitude,
                                    b.facility_latitude, b.facility_longitude) >= 3.0


def test_planning_score_range_and_tiers(spark):
    from deserta.plans import queries as Q

    rows = Q.planning(spark, SF01).select("planning_priority_score", "planning_priority_tier").collect()
    assert all(0 <= r[0] <= 21 for r in rows)
    counts = {}
    for r in rows:
        counts[r[1]] = counts.get(r[1], 0) + 1
    assert counts == {"Urgent": 59, "High": 18, "Watch": 16, "Monitor": 7}


def test_geojson_roundtrip(spark):
    from deserta.sources import fixtures as FX
    from deserta.sources.geojson import scan_geojson, to_geojson_features

    b = FX.boundaries(spark, SF001)
    d = tempfile.mkdtemp(prefix="deserta-geojson-")
    feats = [json.loads(r.value) for r in to_geojson_features(b.orderBy("feature_index")).collect()]
    # a FeatureCollection with one Polygon-typed feature to exercise the wrapping
    single = next(i for i, f in enumerate(feats) if len(f["geometry"]["coordinates"]) == 1)
    feats[single]["geometry"] = {"type": "Polygon", "coordinates": feats[single]["geometry"]["coordinates"][0]}
    with open(os.path.join(d, "b.geojson"), "w") as fh:
        json.dump({"type": "FeatureCollection", "features": feats}, fh)
    back = scan_geojson(spark, d).orderBy("feature_index").collect()
    orig = b.orderBy("feature_index").collect()
    assert len(back) == len(orig)
    assert [r.NAME_2 for r in back] == [r.NAME_2 for r in orig]
    assert [r.geometry for r in back] == [r.geometry for r in orig]


def test_planning_json_sink(spark):
    from deserta.plans import queries as Q
    from deserta.sources.tables import planning_json

    docs = [json.loads(r.value) for r in planning_json(Q.planning(spark, SF001)).collect()]
    assert docs and all("planning_priority_tier" in d and isinstance(d["capable_facilities"], list) for d in docs)


def test_custom_assessor_runs_in_pandas(spark):
    from deserta.operators.assess import assess_facilities, parse_assessment
    from deserta.sources import fixtures as FX

    doc = {"data_confidence": "low", "data_confidence_reason": "stub"}
    for key in ("maternal_neonatal_care", "diabetes_care", "hypertension_care", "nutrition_services",
                "cancer_screening"):
        doc[key] = {"capability": "unknown", "confidence": "low", "evidence": [], "limitation": "stub"}
    text = json.dumps(doc)
    out = parse_assessment(assess_facilities(FX.facilities(spark, SF001), lambda s: s.map(lambda _: text)))
    rows = out.select("diabetes_capability", "data_confidence").distinct().collect()
    assert [tuple(r) for r in rows] == [("unknown", "low")]


def test_key_violations_finds_duplicates(spark):
    from deserta.operators.quality import key_violations

    df = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x"), ("b", "y")], "d string, s string")
    got = {(r.d, r.row_count, r.violation) for r in key_violations(df, ["d", "s"]).collect()}
    assert got == {("a", 2, "duplicate_key"), (None, 1, "null_key")}


def test_indicator_stream_matches_batch(spark):
    from deserta.plans import queries as Q
    from deserta.sources import fixtures as FX
    from deserta.streaming import refresh_indicators

    base = tempfile.mkdtemp(prefix="deserta-stream-")
    raw = FX.survey(spark, SF001)
    raw.write.parquet(os.path.join(base, "in"))
    q = refresh_indicators(spark, os.path.join(base, "in"), raw.schema, os.path.join(base, "out"),
                           os.path.join(base, "ckpt"), allow_missing=True)
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(base, "out"))
    batch = Q.indicators(spark, SF001)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_salted_grid_join_same_pairs(spark):
    from deserta.plans import queries as Q
    from deserta.plans.distances import facility_points
    from deserta.operators.distance_join import within_distance_join
    from deserta.sources import fixtures as FX

    pts, ctr = facility_points(FX.facilities(spark, SF001)), Q.centers(spark, SF001)
    a = within_distance_join(pts, "facility_latitude", "facility_longitude", ctr, "center_latitude",
                             "center_longitude", 160.0).select("unique_id", "district")
    b = within_distance_join(pts, "facility_latitude", "facility_longitude", ctr, "center_latitude",
                             "center_longitude", 160.0, salt_buckets=4).select("unique_id", "district")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_refresh_tables_round_trip(spark):
    from deserta.plans import queries as Q
    from deserta.plans.refresh import refresh_tables
    from deserta.sources import fixtures as FX

    root = tempfile.mkdtemp(prefix="deserta-refresh-")
    served = refresh_tables(FX.survey(spark, SF001, "supplier"), FX.address_directory(spark, SF001),
                            FX.facilities(spark, SF001), FX.master_inputs(spark, SF001), root, allow_missing=True)
    assert set(served) == {"care_desert_indicators", "facility_district_distances", "facility_locations",
                           "healthcare_master_view", "facility_capability"}
    assert spark.table("facility_district_distances").count() == Q.distance_table(spark, SF001).count()
    assert served["care_desert_indicators"].exceptAll(Q.indicators(spark, SF001, "supplier")).count() == 0


def _random_globe(seed, n):
    import random

    rnd = random.Random(seed)
    pts = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2:      # near a pole
            lat = rnd.choice([-1, 1]) * rnd.uniform(85.0, 90.0)
        elif kind < 0.4:    # near the antimeridian
            lat = rnd.uniform(-60.0, 60.0)
        else:
            lat = rnd.uniform(-90.0, 90.0)
        lon = rnd.choice([-1, 1]) * rnd.uniform(175.0, 180.0) if 0.2 <= kind < 0.4 else rnd.uniform(-180.0, 180.0)
        pts.append((i, lat, lon))
    return pts


@pytest.mark.parametrize("radius", [25.0, 400.0, 3000.0])
def test_grid_join_random_globe_equals_brute_force(spark, radius):
    from deserta.operators.distance_join import within_distance_join

    pts = _random_globe(7, 400)
    ctrs = [(f"c{i}", la, lo) for i, la, lo in _random_globe(11, 60)]
    p = spark.createDataFrame(pts, "pid int, lat double, lon double")
    c = spark.createDataFrame(ctrs, "cid string, clat double, clon double")
    got = {(r.pid, r.cid) for r in within_distance_join(p, "lat", "lon", c, "clat", "clon", radius).collect()}
    want = {(i, cid) for i, la, lo in pts for cid, cla, clo in ctrs if haversine_py(la, lo, cla, clo) <= radius}
    assert got == want


def test_knn_random_globe_equals_brute_force(spark):
    from deserta.operators.knn import knn_join

    pts = [(f"p{i:04d}", la, lo, "g1" if i % 5 else "g2") for i, la, lo in _random_globe(3, 300)]
    ctrs = [(f"c{i}", la, lo, g) for i, la, lo in _random_globe(5, 25) for g in ("g1", "g2", "g3")]
    p = spark.createDataFrame(pts, "unique_id string, lat double, lon double, grp string")
    c = spark.createDataFrame(ctrs, "cid string, clat double, clon double, grp string")
    got = {(r.cid, r.grp, r["rank"]): r.unique_id
           for r in knn_join(c, ["cid"], "clat", "clon", p, "lat", "lon", k=3, group_col="grp").collect()}
    want = {}
    for cid, cla, clo, g in ctrs:
        cand = sorted((haversine_py(la, lo, cla, clo), uid) for uid, la, lo, pg in pts if pg == g)
        for r, (_, uid) in enumerate(cand[:3]):
            want[(cid, g, r + 1)] = uid
    assert got == want  # group g3 has no points: no rows, not an error


def test_nearest_falls_back_when_nothing_is_capable(spark):
    from deserta.plans import queries as Q
    from deserta.plans import serving as SV

    p = Q.serving_inputs(spark, SF001)
    cap = p["cap"]
    for c in [c for c in cap.columns if c.endswith("_capability")]:
        cap = cap.withColumn(c, F.lit("unknown"))
    located = SV.attach_capability(p["loc"], cap)
    knn = SV.knn_capable_long(p["geo"], located)
    assert knn.count() == 0
    rows = SV.nearest_facilities(p["geo"], p["loc"], cap, knn).collect()
    assert rows and all(r.category == "overall" and not r.matched_capability for r in rows)
    assert all(r.category_capability == "unknown" for r in rows)
    locs = p["loc"].collect()
    for g in p["geo"].collect():
        want = sorted((haversine_py(f.facility_latitude, f.facility_longitude, g.latitude, g.longitude), f.unique_id)
                      for f in locs)[:3]
        got = sorted((r["rank"], r.unique_id) for r in rows if r.district_key == g.district_key)
        assert [u for _, u in got] == [u for _, u in want]


def test_district_center_of_one_row(spark):
    from deserta.plans import queries as Q
    from deserta.plans import serving as SV

    dist = Q.distance_table(spark, SF001)
    geo = {(r.district_key, r.state_key): (r.latitude, r.longitude) for r in SV.district_geo(dist).collect()}
    (dk, sk), (lat, lon) = sorted(geo.items())[0]
    hit = SV.district_center_of(dist, "  " + dk.lower() + " ", sk.lower()).collect()
    assert len(hit) == 1 and (hit[0].center_latitude, hit[0].center_longitude) == (lat, lon)
    miss = SV.district_center_of(dist, "no such district", sk).collect()
    assert len(miss) == 1 and miss[0].center_latitude is None and miss[0].center_longitude is None
