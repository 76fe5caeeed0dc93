"""Inputs that the derived fixtures never hold: odd numbers, duplicate ids, far facilities, invalid assessments, pages."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F


def test_coordinates_must_be_finite_numbers_in_range(spark):
    from deserta.plans.distances import district_centers, valid_coordinates

    rows = [("a", "s", "10.0", "70"), ("a", "s", "12", "72.0"), ("a", "s", "Infinity", "70"), ("a", "s", "1e300", "70"),
            ("a", "s", "10", "NaN"), ("a", "s", "1d", "2f"), ("a", "s", "91", "70"), ("a", "s", "10", "181"),
            ("a", "s", None, "70"), ("a", "s", "NA", "70"), ("b", "s", "Infinity", "Infinity")]
    df = spark.createDataFrame(rows, "district string, statename string, latitude string, longitude string")
    assert valid_coordinates(df).count() == 2
    assert [tuple(r) for r in district_centers(df).collect()] == [("a", "s", 11.0, 71.0, 2)]


def test_numbers_in_text(spark):
    from deserta.functions.cleaning import coerce_number

    df = spark.createDataFrame([(x,) for x in ("1d", "2f", " 3.5 ", "1e2", ".5", "NaN", "-Infinity", "", None, "0x1")], "x string")
    got = [r[0] for r in df.select(coerce_number("x", None)).collect()]
    assert got == [None, None, 3.5, 100.0, 0.5, None, None, None, None, None]
    assert [r[0] for r in df.select(coerce_number(F.col("x"), None)).collect()] == got


def test_facility_locations_keeps_whole_rows_and_far_facilities(spark):
    from deserta.plans.serving import facility_locations

    rows = [(1, "Zed", "c", "s", 10.0, 80.0), (1, "Abe", "c", "s", 20.0, 70.0), (2, "Far", "c", "s", -60.0, -170.0),
            (3, "None", "c", "s", None, 70.0), (4, "Odd", "c", "s", float("nan"), 70.0)]
    df = spark.createDataFrame(rows, "unique_id long, name string, address_city string, address_stateOrRegion string, "
                                     "latitude double, longitude double")
    assert sorted(tuple(r) for r in facility_locations(df).collect()) == [
        (1, "Abe", "c", "s", 20.0, 70.0), (2, "Far", "c", "s", -60.0, -170.0)]


def test_assessment_audit_is_strict(spark):
    from deserta.functions import capability as C
    from deserta.operators.assess import assessment_violations

    good = {k: {"capability": C.CAPABILITY_VALUES[0], "confidence": C.CONFIDENCE_VALUES[0], "evidence": ["a"], "limitation": ""}
            for k, _ in C.CATEGORIES} | {"data_confidence": C.CONFIDENCE_VALUES[0], "data_confidence_reason": "r"}
    k = C.CATEGORIES[0][0]

    def changed(top=None, **sub):
        return json.dumps({**good, **(top or {}), k: {**good[k], **sub}})
    docs = [json.dumps(good), "[1]", None, changed(capability=None), changed({"data_confidence": None}),
            changed(evidence=None, limitation=None), changed(evidence=[1, {}], limitation=5),
            changed({"data_confidence_reason": 3}), changed(evidence=[]), changed(extra=1), changed(capability="x")]
    df = spark.createDataFrame(list(enumerate(docs)), "unique_id long, assessment string")
    got = {}
    for r in assessment_violations(df).collect():
        got.setdefault(r["unique_id"], set()).add(r["violation"])
    assert got == {1: {"malformed_json"}, 2: {"malformed_json"}, 3: {f"bad_type:{k}.capability"}, 4: {"bad_type:data_confidence"},
                   5: {f"bad_evidence:{k}", f"bad_type:{k}.limitation"}, 6: {f"bad_evidence:{k}", f"bad_type:{k}.limitation"},
                   7: {"bad_type:data_confidence_reason"}, 9: {f"extra_key:{k}.extra"}, 10: {f"bad_enum:{k}.capability"}}


def test_pages_reach_every_district(spark):
    from deserta.plans.serving import paged, planning_page

    rows = [(s, d) for s in ("s1", "s2", "s3") for d in ("a", "b", "c")]
    df = spark.createDataFrame(rows[::-1], "state_ut string, district_name string")
    seen, after = [], None
    while page := [tuple(r) for r in planning_page(df, 4, after).collect()]:
        seen += page
        after = page[-1]
    assert seen == rows
    assert [r["page"] for r in paged(df, 4).orderBy("state_ut", "district_name").collect()] == [1] * 4 + [2] * 4 + [3]


def test_missing_survey_columns_raise(spark):
    from deserta.plans.indicators import nfhs_cleaned

    with pytest.raises(ValueError, match="missing"):
        nfhs_cleaned(spark.createDataFrame([("d", "s")], "district_name string, state_ut string"))


def test_table_comment_is_stored(spark):
    from deserta.sources.tables import materialize

    out = materialize(spark.range(2), os.path.join(tempfile.mkdtemp(prefix="deserta-"), "t"), comment="what it holds")
    assert out.schema["id"].metadata["table_comment"] == "what it holds"


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from deserta import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_features_of_several_files_have_distinct_indexes(spark):
    from deserta.sources.geojson import scan_geojson

    def feature(name):
        return {"type": "Feature", "properties": {"NAME_1": "s", "NAME_2": name},
                "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}}
    root = tempfile.mkdtemp(prefix="deserta-geo-")
    for f, names in (("b.json", "cd"), ("a.json", "ab"), ("c.json", "")):
        with open(os.path.join(root, f), "w") as out:
            json.dump({"type": "FeatureCollection", "features": [feature(n) for n in names]}, out)
    got = sorted((r["feature_index"], r["NAME_2"]) for r in scan_geojson(spark, root).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
