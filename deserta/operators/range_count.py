"""Sums over the points within given distances of every center, without the pairs.

Points of equal coordinates are merged into places, and places are summed up in the pyramid of grid cells that ``knn`` has. Every
center starts with the cells of about the largest radius that its cap may touch and walks down: a cell that lies inside a radius
gives its sum to it, a cell outside gives nothing, and only cells that the circle crosses are divided. The places of the leaves
left on a circle are measured one by one. A center thus meets the cells along its circles, not the points inside: the work
grows with the centers, while the pairs grow with centers times points.

The sums are those of the pairs themselves: a cell counts as inside or outside with a margin beyond rounding, and every place in
between is measured like a pair (``distance_join``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deserta.functions.geo import SERVING_RADIUS_KM, haversine_km
from deserta.operators.distance_join import cap_cells
from deserta.operators.knn import FEW_CELLS, LEAF, LEVELS, SIDE, _ancestors, _leaf_points, _placed, cell_middle, reach_of
from deserta.sources.tables import checkpoint_table, shuffled


def within_distance_sums(points: DataFrame, point_lat: str, point_lon: str, weights: list[str],
                         centers: DataFrame, center_key: str, center_lat: str, center_lon: str,
                         radii_km: dict[str, float], earth_radius_km: float = SERVING_RADIUS_KM) -> DataFrame:
    """``center_key`` and, for each weight and radius, ``<weight>_<radius's name>``: the sum of the weight (a long) over the points
    within the radius. Centers without a point within the largest radius are left out, as are rows without coordinates in range.

    ``center_key`` is unique in ``centers``. Eager: writes the places, the cells and a table of cells met per level to the shared folder.
    """
    names = list(radii_km)
    widest = max(radii_km.values())
    place = points.groupBy(F.col(point_lat).alias("_plat"), F.col(point_lon).alias("_plon")).agg(*[F.sum(w).alias(w) for w in weights])
    places = checkpoint_table(_placed(place, "_plat", "_plon"), "places")
    finest = places.groupBy("_y", "_x").agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(w) for w in weights])
    cells = checkpoint_table(_ancestors(finest).groupBy("level", "y", "x").agg(F.sum("n").alias("n"), *[F.sum(w).alias(w) for w in weights])
                             .withColumn("leaf", F.expr(f"n <= {LEAF} OR level = {LEVELS}")), "cells")
    per_level = {r["level"]: (r["count"], r["split"]) for r in
                 cells.groupBy("level").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("leaf")).alias("split")).collect()}
    ang = math.degrees(widest / earth_radius_km)
    start = max(i for i in range(LEVELS + 1) if i == 0 or 180.0 / SIDE ** i >= ang)
    ctr = centers.select(center_key, F.col(center_lat).alias("_clat"), F.col(center_lon).alias("_clon")).where(
        (F.abs("_clat") <= 90) & (F.abs("_clon") <= 180))
    rows = SIDE ** start
    touched = F.array_distinct(F.transform(
        cap_cells(F.col("_clat"), F.col("_clon"), widest, earth_radius_km, 180.0 / rows, 2 * rows),
        lambda c: F.struct(F.least(c["i"], F.lit(rows - 1)).cast("long").alias("y"), c["j"].cast("long").alias("x"))))
    tasks = int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = (ctr.repartition(tasks, center_key).withColumn("_c", F.explode(touched)).select(center_key, "_clat", "_clon", "_c.*")
             .withColumns({f"_in_{r}": F.lit(True) for r in names}))
    sums = [f"{w}_{r}" for w in weights for r in names]
    found, leaves = [], []
    for level in range(start, LEVELS + 1):
        if level not in per_level:  # no points
            break
        here = cells.where(F.col("level") == level).drop("n")
        if level > start:
            here = here.withColumns({"_py": F.expr(f"y div {SIDE}"), "_px": F.expr(f"x div {SIDE}")})
            asked = asked.withColumnsRenamed({"y": "_py", "x": "_px"})
        if per_level[level][0] > FEW_CELLS:
            here = shuffled(here)
        met = asked.join(here, ["y", "x"] if level == start else ["_py", "_px"])
        size = F.lit(180.0 / SIDE ** level)
        mid_lat, mid_lon = cell_middle("y", "x", size)
        d, reach = haversine_km(F.col("_clat"), F.col("_clon"), mid_lat, mid_lon, earth_radius_km), reach_of(size, mid_lat, earth_radius_km)
        met = met.withColumn("_d", d).withColumn("_r", reach).where(F.col("_d") - F.col("_r") <= widest)
        full = {r: F.col(f"_in_{r}") & (F.col("_d") + F.col("_r") <= radii_km[r]) for r in names}
        crossed = {r: F.col(f"_in_{r}") & ~full[r] & (F.col("_d") - F.col("_r") <= radii_km[r]) for r in names}
        met = met.select(center_key, "_clat", "_clon", "level", "y", "x", "leaf",
                         *[F.when(full[r], F.col(w)).alias(f"{w}_{r}") for w in weights for r in names],
                         *[crossed[r].alias(f"_in_{r}") for r in names])
        some = reduce(Column.__or__, [F.col(f"_in_{r}") for r in names])
        gives = reduce(Column.__or__, [F.col(c).isNotNull() for c in sums])
        met = checkpoint_table(met.withColumn("_open", some).where(some | gives), "met")
        found.append(met.where(gives).select(center_key, *sums))
        on_circle = met.where("_open").drop("_open", *sums)
        leaves.append(on_circle.where("leaf").drop("leaf"))
        asked = on_circle.where("NOT leaf").drop("leaf", "level")
        if not per_level[level][1]:
            break
    if leaves:
        pairs = shuffled(reduce(DataFrame.unionByName, leaves)).join(_leaf_points(places, cells.where(F.col("level") >= start), []), ["level", "y", "x"])
        km = pairs.withColumn("_d", haversine_km("_plat", "_plon", "_clat", "_clon", earth_radius_km)).where(F.col("_d") <= widest)
        found.append(km.select(center_key, *[F.when(F.col(f"_in_{r}") & (F.col("_d") <= radii_km[r]), F.col(w)).alias(f"{w}_{r}")
                                             for w in weights for r in names]))
    if not found:
        return ctr.select(center_key, *[F.lit(0).cast("long").alias(c) for c in sums]).where("false")
    last = names[list(radii_km.values()).index(widest)]
    return (reduce(DataFrame.unionByName, found).groupBy(center_key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
            .where(F.col(f"{weights[0]}_{last}") > 0))
