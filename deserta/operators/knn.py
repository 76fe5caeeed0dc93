"""Exact k nearest points per (center, group) without a distance cap and without a cross join.

Points are counted in a pyramid of grid cells, each level four times finer per side. A cell of at most ``LEAF`` points, or of
the finest level, is a leaf: it is not divided, and every point belongs to one leaf. The centers go down the same pyramid: all
centers of a cell (and group) share one frontier of point cells. A point cell lies between a smallest and a largest distance
from every center of the cell, the k-th smallest largest distance (counting points) bounds the k-th neighbour of each of them,
and point cells that begin beyond it are dropped. Where point cells are left that are no leaves, the cell of centers is divided
along with them; otherwise it is done. The leaves of a cell's frontier are then narrowed for each of its centers and joined with
their points. There are as many rounds as the densest place needs, and the frontiers number as the cells of centers.

Dense and empty places are thus searched at their own scale: a center in a city sees its own streets, a center far from
everything descends into the nearest few cells of the nearest cluster, and neither meets all points of either. All joins are
equi-joins on (cell, group) with at most 16 children to a cell, all limits are windows over one frontier. Points of
equal coordinates can only differ in the tie-break, so only the first k of them enter.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deserta.functions.geo import SERVING_RADIUS_KM, haversine_km

#: Cells of level i are 180 / SIDE**i degrees wide; the finest level has cells of about 5 m.
SIDE, LEVELS = 4, 11
#: Cells of at most this many points (of one group) are not divided.
LEAF = 16
#: A level of more cells is not broadcast to the frontier, whatever the size of its file.
FEW_CELLS = 20_000
#: The search begins at the finest of the first levels that has at most so many cells.
FIRST_LEVELS, FIRST_CELLS = 3, 1_000


def _checkpoint(df: DataFrame) -> DataFrame:
    from deserta.sources.tables import checkpoint_table

    return checkpoint_table(df, "knn")


def _cell(degrees, offset: float, count: int):
    """Index of a coordinate among ``count`` finest cells of one axis."""
    size = 180.0 / SIDE ** LEVELS
    return F.least(F.floor((degrees + offset) / size), F.lit(count - 1)).cast("long")


def _ancestors(finest: DataFrame) -> DataFrame:
    """Every row of ``finest`` once per level, with the cell (level, y, x) that holds its finest cell."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.expr(f"_y div {SIDE ** (LEVELS - i)}").alias("y"),
                                          F.expr(f"_x div {SIDE ** (LEVELS - i)}").alias("x")) for i in range(LEVELS + 1)]))
    return finest.select("*", levels.alias("c")).select("*", "c.*").drop("c")


def _cell_counts(points: DataFrame, groups: list[str]) -> DataFrame:
    """level, y, x, group, n, leaf: points per cell of every level, from one partial aggregation."""
    finest = points.groupBy(*groups, "_y", "_x").agg(F.count(F.lit(1)).alias("n"))
    return (_ancestors(finest).groupBy("level", "y", "x", *groups).agg(F.sum("n").alias("n"))
            .withColumn("leaf", F.expr(f"n <= {LEAF} OR level = {LEVELS}")))


def _leaf_points(placed: DataFrame, cells: DataFrame, groups: list[str]) -> DataFrame:
    """``placed`` with the leaf (level, y, x) of every point, looked up once per finest cell."""
    from deserta.sources.tables import shuffled

    finest = placed.select(*groups, "_y", "_x").distinct()
    first = F.min(F.struct("level", "y", "x")).alias("c")
    of_finest = (_ancestors(finest).join(shuffled(cells.where("leaf").select("level", "y", "x", *groups)), ["level", "y", "x", *groups])
                 .groupBy(*groups, "_y", "_x").agg(first))
    return shuffled(placed).join(of_finest, [*groups, "_y", "_x"]).select("*", "c.*").drop("c", "_y", "_x")


def reach_of(size: Column, mid_lat: Column, radius: float) -> Column:
    """A distance that no point of a cell of ``size`` degrees exceeds from the cell's middle."""
    widest = F.cos(F.radians(F.greatest(F.abs(mid_lat) - size / 2, F.lit(0.0))))
    return radius * F.radians(size / 2) * (1 + widest) * (1 + 1e-9) + 1e-3


def cell_middle(y: str, x: str, size: Column) -> tuple[Column, Column]:
    return F.col(y) * size + (size / 2 - 90.0), F.col(x) * size + (size / 2 - 180.0)


def _pruned(frontier: DataFrame, part: list[str], lat: str, lon: str, k: int, radius: float) -> DataFrame:
    """The frontier's cells that may hold one of the k nearest points of a center no further than ``_own`` (0 if there is no such
    column) from (``lat``, ``lon``); ``_bound``: what bounds the distance of the k-th (null: fewer points)."""
    size = F.lit(180.0) / F.pow(F.lit(float(SIDE)), F.col("level"))
    mid_lat, mid_lon = cell_middle("y", "x", size)
    reach = reach_of(size, mid_lat, radius)
    if "_own" in frontier.columns:
        reach = reach + F.col("_own")
    d = haversine_km(F.col(lat), F.col(lon), mid_lat, mid_lon, radius)
    near = frontier.withColumn("_d", d).withColumn("_r", reach).withColumn("_far", F.col("_d") + F.col("_r"))
    by_far = Window.partitionBy(*part).orderBy("_far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_held", F.sum("n").over(by_far))
    enough = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(Window.partitionBy(*part))
    return (near.withColumn("_bound", enough).where("_bound IS NULL OR _d - _r <= _bound")
            .drop("_d", "_r", "_far", "_held"))


def _placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """``df`` with the finest cell (_y, _x) of its coordinates; rows without coordinates in range are left out."""
    return (df.where((F.abs(lat) <= 90) & (F.abs(lon) <= 180)).withColumn("_y", _cell(F.col(lat), 90.0, SIDE ** LEVELS))
            .withColumn("_x", _cell(F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0, 180.0, 2 * SIDE ** LEVELS)))


def _center_cells(ctr: DataFrame, level: int, groups: list[str], radius: float) -> DataFrame:
    """The cells of a level (_cy, _cx) that hold centers, with their middles and reach."""
    size = F.lit(180.0 / SIDE ** level)
    mid_lat, mid_lon = cell_middle("_cy", "_cx", size)
    scale = SIDE ** (LEVELS - level)
    held = ctr.select(*groups, F.expr(f"_y div {scale}").alias("_cy"), F.expr(f"_x div {scale}").alias("_cx")).distinct()
    return held.select("*", mid_lat.alias("_mlat"), mid_lon.alias("_mlon"), reach_of(size, mid_lat, radius).alias("_own"))


def _frontiers(ctr: DataFrame, cells: DataFrame, per_level: dict, start: int, groups: list[str], k: int,
               radius: float) -> list[DataFrame]:
    """For each level a table of the cells of centers (_cl, _cy, _cx) that are done there, with the leaves (level, y, x, n) that may
    hold one of the k nearest points of one of their centers."""
    from deserta.sources.tables import shuffled

    deepest = max((level for level, (_, split) in per_level.items() if split and level >= start), default=-1)
    # A frontier is many times its cell's row: by number, so that few small rows are not put into one task.
    tasks = int(ctr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own = ["_cy", "_cx", *groups], ["_mlat", "_mlon", "_own"]
    cell = ["level", "y", "x", "n", "leaf"]
    # All cells of the first level, met by a number that is 0 for both sides.
    first = cells.where(F.col("level") == start).withColumn("_all", F.expr(f"y div {SIDE ** LEVELS}"))
    met = (_center_cells(ctr, start, groups, radius).withColumn("_all", F.expr(f"_cy div {SIDE ** LEVELS}")).repartition(tasks, "_cy", "_cx", *groups)
           .join(first, ["_all", *groups]).select(*part, *own, *cell))
    done = []
    for level in range(start, max(deepest + 1, start) + 1):
        kept = _pruned(met, part, "_mlat", "_mlon", k, radius)
        more = F.max(~F.col("leaf")).over(Window.partitionBy(*part))
        held = _checkpoint(kept.select(*part, *cell, "_bound", more.alias("_more")))
        done.append(held.where("NOT _more").select(F.lit(level).alias("_cl"), *part, "level", "y", "x", "n"))
        if level > deepest:
            break
        up = held.where("_more").select(F.col("_cy").alias("_qy"), F.col("_cx").alias("_qx"), *groups, *cell, "_bound").repartition(
            tasks, "_qy", "_qx", *groups)
        # A leaf stays as it is; its number of an undivided parent is null and finds no children.
        up = up.withColumn("_py", F.expr("CASE WHEN NOT leaf THEN y END")).withColumn("_px", F.col("x"))
        children = cells.where(F.col("level") == level + 1).select(
            F.expr(f"y div {SIDE}").alias("_py"), F.expr(f"x div {SIDE}").alias("_px"), *groups,
            F.struct(*cell).alias("_child"))
        if per_level[level + 1][0] > FEW_CELLS:
            children = shuffled(children)
        parts = _center_cells(ctr, level + 1, groups, radius).withColumns({"_qy": F.expr(f"_cy div {SIDE}"), "_qx": F.expr(f"_cx div {SIDE}")})
        down = up.join(shuffled(parts), ["_qy", "_qx", *groups]).join(children, ["_py", "_px", *groups], "left").where("leaf OR _child IS NOT NULL")
        met = down.select(*part, *own, "_bound", F.coalesce("_child", F.struct(*cell)).alias("_c")).select(*part, *own, "_bound", "_c.*")
        # What is beyond the bound of the divided cell of centers need not be shuffled.
        size = F.lit(180.0) / F.pow(F.lit(float(SIDE)), F.col("level"))
        mid_lat, mid_lon = cell_middle("y", "x", size)
        near = haversine_km(F.col("_mlat"), F.col("_mlon"), mid_lat, mid_lon, radius) - reach_of(size, mid_lat, radius) - F.col("_own")
        met = met.where(F.col("_bound").isNull() | (near <= F.col("_bound"))).drop("_bound")
    return done


def knn_join(centers: DataFrame, center_keys: list[str], center_lat: str, center_lon: str,
             points: DataFrame, point_lat: str, point_lon: str, k: int = 3,
             group_col: str | None = None, tie_break: str = "unique_id",
             earth_radius_km: float = SERVING_RADIUS_KM,
             distance_col: str = "distance_kilometers", rank_col: str = "rank") -> DataFrame:
    """For every center (and group, when ``group_col`` is given on both sides) the ``k`` nearest points.

    ``centers``: one row per center key (and group). ``points``: the candidates, with ``group_col`` when grouped.
    Returns center keys, group, rank (1..k), all point columns and the distance. Ties are broken by ``tie_break``. Rows
    without finite coordinates in range take no part; a group of fewer than k points gives them all.

    Eager: writes the placed centers and points, the cell counts, every frontier and the result to the shared folder.
    """
    from deserta.sources.tables import shuffled

    groups = [group_col] if group_col else []
    part = center_keys + groups
    ctr = _placed(centers.select(*part, F.col(center_lat).alias("_clat"), F.col(center_lon).alias("_clon")), "_clat", "_clon")
    ctr = _checkpoint(ctr.withColumn("_id", F.monotonically_increasing_id()))
    same_place = Window.partitionBy(*groups, point_lat, point_lon).orderBy(F.col(tie_break).asc())
    placed = _checkpoint(_placed(points, point_lat, point_lon).withColumn("_at", F.row_number().over(same_place))
                         .where(F.col("_at") <= k).drop("_at"))
    cells = _checkpoint(_cell_counts(placed, groups))
    per_level = {r["level"]: (r["count"], r["split"]) for r in
                 cells.groupBy("level").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("leaf")).alias("split")).collect()}
    start = max(level for level in range(FIRST_LEVELS + 1) if level == 0 or per_level.get(level, (0, 0))[0] <= FIRST_CELLS)
    cells = cells.where(F.col("level") >= start)
    done = _frontiers(ctr, cells, per_level, start, groups, k, earth_radius_km)
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("_cl"), F.expr(f"_y div {SIDE ** (LEVELS - i)}").alias("_cy"),
                                          F.expr(f"_x div {SIDE ** (LEVELS - i)}").alias("_cx")) for i in range(start, start + len(done))]))
    own = ["_cl", "_cy", "_cx", *groups]
    near = (ctr.withColumn("_c", levels).select(*part, "_id", "_clat", "_clon", "_c.*")
            .join(shuffled(functools.reduce(DataFrame.unionByName, done)), own))
    # Partitioned by the centers' cells, as the join has left them.
    near = _pruned(near, [*own, "_id"], "_clat", "_clon", k, earth_radius_km).select("_id", "_clat", "_clon", *part, "level", "y", "x")
    found = shuffled(near.drop(*center_keys)).join(_leaf_points(placed, cells, groups), ["level", "y", "x", *groups])
    d = haversine_km(F.col(point_lat), F.col(point_lon), F.col("_clat"), F.col("_clon"), earth_radius_km)
    nearest = Window.partitionBy("_id").orderBy(F.col(distance_col).asc(), F.col(tie_break).asc())
    ranked = (found.withColumn(distance_col, d).drop("_clat", "_clon", "level", "y", "x")
              .withColumn(rank_col, F.row_number().over(nearest)).where(F.col(rank_col) <= k))
    return _checkpoint(shuffled(ranked).join(ctr.select("_id", *center_keys), "_id").drop("_id"))


def ordered_topk(knn: DataFrame, keys: list[str], fields: list[str], rank_col: str = "rank",
                 out_col: str = "facilities") -> DataFrame:
    """A5: per key, the (at most k) rows as an array of struct(fields) ordered by rank."""
    return (
        knn.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("_r"), *[F.col(f) for f in fields])))
             .alias("_a"))
        .select(*keys, F.transform("_a", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(out_col))
    )
