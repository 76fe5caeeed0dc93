"""The refresh: links are written by tasks that grow with the facilities, centers are made once, served files are zstd."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from deserta.functions.geo import haversine_py
from deserta.operators import distance_join as J
from deserta.plans import indicators as I
from deserta.plans.refresh import refresh_tables
from deserta.sources.tables import materialize

RADIUS = 30.0


def _sides(seed=3):
    r = random.Random(seed)
    points = [(i, r.uniform(10, 30), r.uniform(70, 90)) for i in range(2500)]
    points += [(3000 + i, 12.0 + r.uniform(0, 0.2), 77.0 + r.uniform(0, 0.2)) for i in range(400)]
    points += [(3000, 12.1, 77.1), (4000, None, 1.0), (4001, 12.0, 77.0), (4001, 12.0, 77.0)]  # a key twice, no latitude, a row twice
    centers = [(i, r.uniform(10, 30), r.uniform(70, 90)) for i in range(120)]
    centers += [(500, 12.1, 77.1), (500, 12.1, 77.1), (501, None, 77.1), (502, 12.0, 77.2)]
    return points, centers


@pytest.mark.parametrize("dense", [10 ** 6, 50])
def test_links_are_exact_and_written_by_many_tasks(spark, monkeypatch, dense):
    monkeypatch.setattr(J, "TASK_POINTS", 30, raising=False)
    monkeypatch.setattr(J, "SALTED", 50)
    points, centers = _sides()
    p = spark.createDataFrame(points, "pid long, lat double, lon double")
    c = spark.createDataFrame(centers, "cid long, clat double, clon double")
    links = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", RADIUS, 6371.0, dense_cell=dense)
    out = materialize(links, os.path.join(tempfile.mkdtemp(prefix="deserta-"), "links"))
    want = sorted((i, k) for i, a, b in points for k, la, lo in centers
                  if a is not None and la is not None and haversine_py(a, b, la, lo, 6371.0) <= RADIUS)
    assert sorted((x["pid"], x["cid"]) for x in out.collect()) == want and len(want) > 1000
    assert len({x["f"] for x in out.select(F.input_file_name().alias("f")).collect()}) > 20


def test_few_points_are_left_to_adaptive_execution(spark):
    points, centers = _sides()
    p = spark.createDataFrame(points, "pid long, lat double, lon double")
    c = spark.createDataFrame(centers, "cid long, clat double, clon double")
    plan = J.within_distance_join(p, "lat", "lon", c, "clat", "clon", RADIUS, dense_cell=10 ** 6)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" not in plan


def test_served_files_are_zstd(spark):
    import pyarrow.parquet as pq

    root = os.path.join(tempfile.mkdtemp(prefix="deserta-"), "t")
    assert materialize(spark.range(1000), root).count() == 1000
    used = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in glob.glob(f"{root}/*.parquet")}
    assert used == {"ZSTD"}


def test_the_directory_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def district(x):
        seen.add(1)
        return x

    rows = [("D0", "S0", "12.0", "77.0"), ("D0", "S0", "12.2", "77.2"), ("D1", "S0", "NA", "77.0"), ("D2", None, "20.0", "80.0"), (None, "S0", "12.5", "77.0")]
    directory = spark.createDataFrame(rows, "district string, statename string, latitude string, longitude string")
    directory = directory.withColumn("district", district.asNondeterministic()("district"))
    facilities = spark.createDataFrame(
        [("f1", "One", "c", "S0", 12.1, 77.1), ("f1", "One", "c", "S0", 12.1, 77.1), ("f2", "Two", "c", "S0", 20.1, 80.1), ("f3", "Three", "c", "S0", None, None)],
        "unique_id string, name string, address_city string, address_stateOrRegion string, latitude double, longitude double")
    facilities = facilities.withColumns({c: F.lit("diabetes clinic") for c in ("description", "specialties", "equipment", "procedure", "capability")})
    survey = spark.createDataFrame([("D0", "S0")], "district_name string, state_ut string").withColumns(
        {c: F.lit("50.0") if c in I.CLEANED_TEXT_COLUMNS else F.lit(50.0) for c in I.SURVEY_COLUMNS if c not in ("district_name", "state_ut")})
    master = spark.createDataFrame(
        [("D0", "S0", 1.0, "Low Availability", None, 2.0), ("D9", "S0", 1.0, "Low Availability", None, 2.0)],
        "district_name string, state_ut string, overall_availability_score double, overall_availability_category string, intervention_priority string, "
        "estimated_population_impact double")
    served = refresh_tables(survey, directory, facilities, master, os.path.join(tempfile.mkdtemp(prefix="deserta-"), "served"))
    got = sorted((x["unique_id"], x["district"] or "", x["statename"] or "") for x in served["facility_district_distances"].collect())
    assert got == sorted([("f1", "D0", "S0")] * 2 + [("f1", "", "S0")] * 2 + [("f2", "D2", "")])
    totals = {x["district_name"]: x["total_facilities"] for x in served["healthcare_master_view"].collect()}
    assert totals["D9"] is None and totals["D0"] == 4
    assert seen.value == len(rows)
