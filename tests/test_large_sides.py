"""Sides of joins that grow with the data are neither broadcast, written needlessly nor left in one task."""

from conftest import SF001, assert_same
from deserta.plans import console as CO, queries as Q, serving as SV
from deserta.sources import fixtures as FX


def test_nearest_facilities_broadcasts_no_table(spark):
    """Facilities, capabilities and districts compress to a fraction of their rows, so the size of their files says little."""
    p = Q.serving_inputs(spark, SF001)
    near = SV.nearest_facilities(p["geo"], p["loc"], p["cap"], Q.knn_long(spark, SF001, p))
    for df in (near, CO.map_bounds(CO.thin_nearest(near), p["geo"])):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_links_are_summed_up_where_they_are_made(spark):
    """The link table is not written for the serving queries, and capabilities come along with the facilities."""
    p = Q.serving_inputs(spark, SF001)
    assert all("/tables/facility_district_distances-" not in f for f in p["dist"].inputFiles())
    inputs = FX.master_inputs(spark, SF001)
    rated = SV.master_view(inputs, p["dist"], p["cap"])
    assert_same(rated, SV.master_view(inputs, Q.distance_table(spark, SF001), p["cap"]).toPandas())


def test_assessment_of_one_file_runs_in_many_tasks(spark):
    one = spark.createDataFrame([(str(i), f"clinic {i}", "obstetric care", None, None, None, None) for i in range(200)],
                                "unique_id string, name string, description string, specialties string, equipment string, "
                                "procedure string, capability string").coalesce(1)
    from deserta.operators.assess import assess_facilities

    assert assess_facilities(one).rdd.getNumPartitions() > 1


def test_boundary_features_matches_once(spark, monkeypatch):
    calls, match = [], CO.boundary_matches
    monkeypatch.setattr(CO, "boundary_matches", lambda *a, **k: calls.append(1) or match(*a, **k))
    assert Q.q_boundary_features(spark, SF001).count() > 0 and len(calls) == 1


def test_boundary_joins_read_the_directory_once(spark, monkeypatch):
    read, table = [], Q.CO.boundary_matches
    monkeypatch.setattr(CO, "boundary_matches", lambda b, *a, **k: read.extend(b.inputFiles()) or table(b, *a, **k))
    Q.q_point_in_polygon_join(spark, SF001)
    Q.q_unreported_boundaries(spark, SF001)
    assert read and not [f for f in read if "lineitem" in f]


def test_clusters_make_no_links(spark, monkeypatch):
    """The centers of the points come from sums of the links, and the points are written once; they are those of the link table."""
    monkeypatch.setattr(Q.DS, "facility_district_distances", None)
    points = Q.proximity_points(spark, SF001)
    assert points.inputFiles() and all("/tables/legacy_points-" in f for f in points.inputFiles())
    monkeypatch.undo()
    assert_same(points.drop("scores"), Q.legacy_points(spark, SF001).drop("scores").toPandas())
