"""Distance-range join without a cross join.

Points get exactly one grid cell; each center is exploded into every cell its spherical-cap bounding box touches
(latitude +- r/R; longitude +- asin(sin(r/R)/cos(lat)), the full circle when the cap reaches a pole; columns wrap at
+-180). An equi-join on the cell pair produces each candidate pair at most once, and the exact haversine filter
keeps the true matches. With ``cell >= r`` a center touches at most ~16 cells, so the exploded side grows linearly.

Execution: a shuffle join on (cell_i, cell_j), never a broadcast of the exploded centers; AQE's skew-join handling splits a
hot cell (a dense city with a third of all points) across tasks.

With ``dense_cell``, the points per cell are counted first. A cell of more points is divided into ``FINE`` x ``FINE`` small cells;
its centers go to those small cells with points that their caps may touch, and a small cell that still holds more than that and
``SALTED`` (equal coordinates, say) is spread over as many salts as it needs. No join key then has many more points than the larger
of both, whatever the crowd, and centers at the edge of a city meet its near side only. Every salt costs a copy of each center within
reach, so a lower ``dense_cell`` makes small cells but no further salts. Without a dense cell the keys are the plain ones.

The pairs can outnumber both inputs by far, and adaptive execution sizes its tasks by the inputs. So the join has a task for every
``TASK_POINTS`` counted points, where these are more than the slots; fewer points are left to adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deserta.functions.geo import SERVING_RADIUS_KM, haversine_km
from deserta.sources.tables import shuffled

# Bounding boxes are widened by this many degrees so rounding in the trig never drops a boundary pair.
_MARGIN_DEG = 1e-6
#: Small cells per side of a dense cell.
FINE = 16
#: Points that a small cell may hold without salts, whatever ``dense_cell``.
SALTED = 1_000
#: Points to a task of the join.
TASK_POINTS = 10_000


def grid_spec(radius_km: float, earth_radius_km: float, cell_deg: float | None = None) -> tuple[float, int]:
    """Cell size (degrees, dividing 360 exactly) and the number of longitude columns."""
    want = cell_deg if cell_deg else max(math.degrees(radius_km / earth_radius_km), 0.05)
    ncols = max(1, math.ceil(360.0 / want))
    return 360.0 / ncols, ncols


def point_cell(lat: Column, lon: Column, cell: float, ncols: int) -> tuple[Column, Column]:
    i = F.floor((lat + 90.0) / cell)
    j = F.pmod(F.floor((lon + 180.0) / cell), F.lit(ncols))
    return i, j


def cap_cells(lat: Column, lon: Column, radius_km: float, earth_radius_km: float, cell: float, ncols: int) -> Column:
    """Array of struct(i, j) for every cell the cap of ``radius_km`` around (lat, lon) may touch."""
    ang = radius_km / earth_radius_km
    dlat = math.degrees(ang) + _MARGIN_DEG
    lat_lo = F.greatest(lat - dlat, F.lit(-90.0))
    lat_hi = F.least(lat + dlat, F.lit(90.0))
    polar = (F.abs(lat) + dlat) >= 90.0
    if ang >= math.pi / 2:
        dlon = F.lit(180.0)
    else:
        ratio = F.lit(math.sin(ang)) / F.cos(F.radians(lat))
        dlon = F.when(polar | (ratio >= 1.0), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + _MARGIN_DEG)
    i_lo = F.floor((lat_lo + 90.0) / cell)
    i_hi = F.floor((lat_hi + 90.0) / cell)
    j_lo = F.floor((lon + 180.0 - dlon) / cell)
    j_hi = F.floor((lon + 180.0 + dlon) / cell)
    full = (j_hi - j_lo + 1) >= ncols
    j_lo2 = F.when(full, F.lit(0).cast("long")).otherwise(j_lo)
    j_hi2 = F.when(full, F.lit(ncols - 1).cast("long")).otherwise(j_hi)
    js = F.transform(F.sequence(j_lo2, j_hi2), lambda j: F.pmod(j, F.lit(ncols)))
    return F.flatten(F.transform(F.sequence(i_lo, i_hi),
                                 lambda i: F.transform(js, lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _counted(pts: DataFrame, keys: list[str], dense_cell: int, salted: int | None = None) -> DataFrame:
    """The small cells with points of all dense cells: cell, small cell, keys and the number of salts of the small cell, one for
    every ``salted`` points (``dense_cell`` when not given)."""
    fine = pts.groupBy("_ci", "_cj", "_fi", "_fj", *keys).agg(F.count(F.lit(1)).alias("_n"))
    dense = fine.groupBy("_ci", "_cj", *keys).agg(F.sum("_n").alias("_all")).where(F.col("_all") > dense_cell)
    return fine.join(dense, ["_ci", "_cj", *keys]).select(
        "_ci", "_cj", "_fi", "_fj", *keys, F.ceil(F.col("_n") / (salted or dense_cell)).cast("long").alias("_salts"))


def split_points(pts: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their join key (_ci, _cj, _fi, _fj, _salt): -1, -1, 0 for the last three outside dense cells. The salt is a
    hash of the whole row, so that a task that runs again gives the same."""
    spread = F.coalesce(F.pmod(F.xxhash64(*[c for c in pts.columns if not c.startswith("_")]), F.col("_salts")), F.lit(0))
    return (pts.join(small, ["_ci", "_cj", "_fi", "_fj", *keys], "left").withColumns({
        "_salt": spread.cast("long"), "_fi": F.expr("CASE WHEN _salts IS NULL THEN -1 ELSE _fi END"),
        "_fj": F.expr("CASE WHEN _salts IS NULL THEN -1 ELSE _fj END")}).drop("_salts"))


def split_centers(ctr: DataFrame, small: DataFrame, keys: list[str], lat: str, lon: str, radius_km: float,
                  earth_radius_km: float, fine_deg: float) -> DataFrame:
    """Centers, one row per cell, with the join keys of ``split_points``: in a dense cell one row per small cell within reach and salt."""
    met = ctr.join(small, ["_ci", "_cj", *keys], "left")
    mid_lat, mid_lon = (F.col("_fi") + 0.5) * fine_deg - 90.0, (F.col("_fj") + 0.5) * fine_deg - 180.0
    widest = F.cos(F.radians(F.greatest(F.abs(mid_lat) - fine_deg / 2, F.lit(0.0))))
    reach = earth_radius_km * math.radians(fine_deg / 2) * (1 + widest) * (1 + 1e-9) + 1e-3  # from the middle to any point
    near = haversine_km(F.col(lat), F.col(lon), mid_lat, mid_lon, earth_radius_km) <= radius_km + reach
    return (met.where(F.col("_salts").isNull() | near)
            .withColumn("_salt", F.explode(F.expr("sequence(0L, coalesce(_salts, 1L) - 1)")))
            .withColumns({"_fi": F.coalesce("_fi", F.lit(-1)), "_fj": F.coalesce("_fj", F.lit(-1))}).drop("_salts"))


def within_distance_join(points: DataFrame, point_lat: str, point_lon: str,
                         centers: DataFrame, center_lat: str, center_lon: str,
                         radius_km: float, earth_radius_km: float = SERVING_RADIUS_KM,
                         cell_deg: float | None = None, distance_col: str = "distance_kilometers",
                         keys: list[str] | None = None, salt_buckets: int = 1, dense_cell: int | None = None) -> DataFrame:
    """All (point, center) pairs with great-circle distance <= ``radius_km``; both inputs keep their columns.

    ``keys``: extra equi-join columns present on both sides (e.g. a service), added to the cell key.
    ``salt_buckets``: when > 1, points are spread over that many buckets by a hash of their coordinates and each
    exploded center row is replicated into every bucket, so one dense cell is split across tasks even where AQE
    skew handling is off. ``dense_cell``: count the points per cell (one job) and split cells of more points than this; the
    points' own columns must not begin with an underscore, and ``salt_buckets`` is not needed then. Rows with a NULL coordinate on either side never match (they are filtered first).
    """
    keys = list(keys or [])
    cell, ncols = grid_spec(radius_km, earth_radius_km, cell_deg)
    pts = points.filter(F.col(point_lat).isNotNull() & F.col(point_lon).isNotNull())
    pi, pj = point_cell(F.col(point_lat), F.col(point_lon), cell, ncols)
    pts = pts.withColumn("_ci", pi).withColumn("_cj", pj)
    ctr = centers.filter(F.col(center_lat).isNotNull() & F.col(center_lon).isNotNull())
    ctr = (ctr.withColumn("_cell", F.explode(cap_cells(F.col(center_lat), F.col(center_lon), radius_km,
                                                       earth_radius_km, cell, ncols)))
           .withColumn("_ci", F.col("_cell.i")).withColumn("_cj", F.col("_cell.j")).drop("_cell"))
    on = ["_ci", "_cj"] + keys
    if dense_cell:
        fine_i, fine_j = point_cell(F.col(point_lat), F.col(point_lon), cell / FINE, ncols * FINE)
        pts = pts.withColumn("_fi", fine_i).withColumn("_fj", fine_j).withColumns(
            {"_ci": F.floor(F.col("_fi") / FINE), "_cj": F.floor(F.col("_fj") / FINE)})
        fullest, total = (n or 0 for n in pts.groupBy("_ci", "_cj", *keys).count().agg(F.max("count"), F.sum("count")).first())
        if fullest > dense_cell:
            small = _counted(pts, keys, dense_cell, max(dense_cell, SALTED))
            pts = split_points(pts, small, keys)
            ctr = split_centers(ctr, small, keys, center_lat, center_lon, radius_km, earth_radius_km, cell / FINE)
            on = ["_ci", "_cj", "_fi", "_fj", "_salt"] + keys
        tasks = total // TASK_POINTS
        if tasks > pts.sparkSession.sparkContext.defaultParallelism:
            pts, ctr = pts.repartition(tasks, *on), ctr.repartition(tasks, *on)
    if salt_buckets > 1 and "_salt" not in on:
        pts = pts.withColumn("_salt", F.pmod(F.xxhash64(point_lat, point_lon), F.lit(salt_buckets)))
        ctr = ctr.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt_buckets - 1).cast("long"))))
        on = on + ["_salt"]
    dist = haversine_km(point_lat, point_lon, center_lat, center_lon, earth_radius_km)
    return (
        pts.join(shuffled(ctr), on)
        .withColumn(distance_col, dist)
        .filter(F.col(distance_col) <= radius_km)
        .drop("_ci", "_cj", "_fi", "_fj", "_salt")
    )
