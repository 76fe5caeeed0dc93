"""Greedy thinning of whole link lists: nearest first, a place goes when one already kept lies within ``min_km``.

The walk keeps a place exactly if no nearer kept place of its group is close to it. Instead of gathering a group, rounds
decide everywhere at once:

* every grid cell of a group reports its nearest live place (a grouped minimum, summed map-side);
* a cell's place is kept if no cell that its circle of ``min_km`` touches reports a nearer one: nothing live could block it;
* live places close to a kept one go. Kept places lie apart, so only a few of them touch any cell.

The nearest live place of every group is kept in each round, so the rounds end, and they end in the result of the walk. The
number of rounds is that of the longest chain of ever nearer neighbouring cells: a few where places are sparse, and at
most about the radius of a group over a cell where they cover it whole. No pairs of places are made and no list is gathered: a
round joins cells with cells and places with kept ones, by shuffles only, and is written to the shared folder.

``thin_within`` thins the links within a distance of every center without writing them, as they grow with places times centers. Its
state is a row per center and grid cell within reach: the cell's nearest live place and the kept places that cover a part of it.

* The links of a cell are made from its places and summed up to the nearest one (a minimum, summed map-side) in the same task.
* A cell that one kept place covers whole is dropped unread. It is read again only when its nearest place is close to a new kept one.
* Cells go in blocks as wide as ``min_km`` or wider; the nearest place of a block is kept if no block that its circle touches has a nearer one.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deserta.functions.geo import SERVING_RADIUS_KM, haversine_km
from deserta.operators.distance_join import cap_cells, point_cell, within_distance_join
from deserta.operators.knn import cell_middle, reach_of
from deserta.operators.numbering import numbered
from deserta.sources.tables import checkpoint_table, shuffled

CELLS_ACROSS = 3
MIN_CELL_DEG = 0.002
#: Places of a cell to a join key, and places to a task where these are more than the slots.
SALTED = 2_000


def thin_links(links: DataFrame, group: list[str], rank: list[str], lat: str, lon: str, min_km: float,
               earth_radius_km: float = SERVING_RADIUS_KM) -> DataFrame:
    """The rows of ``links`` that the walk keeps in each group, with their columns.

    Order within a group: the ``rank`` columns, then the coordinates, then the other columns (all must be orderable; nulls
    first). Rows equal in all columns are one place, of which one row is kept. A null group value is a group of its own. Rows with a
    coordinate that is null or NaN are close to nothing and all stay, as does everything where ``min_km`` is not positive.
    """
    if min_km <= 0:
        return links
    cell = max(math.degrees(min_km / earth_radius_km) / CELLS_ACROSS, MIN_CELL_DEG)
    ncols = max(1, math.floor(360.0 / cell))
    cell = 360.0 / ncols
    first = [*rank, lat, lon]
    row = F.struct(*first, *[c for c in links.columns if c not in first])
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    i, j = point_cell(F.col(lat), F.col(lon), cell, ncols)
    cells = ["_g", "_i", "_j"]
    live = checkpoint_table(links.where(placed).select(key.alias("_g"), i.alias("_i"), j.alias("_j"), row.alias("_r")), "places")
    kept = []

    def touched(df):
        at = cap_cells(F.col(f"_r.{lat}"), F.col(f"_r.{lon}"), min_km, earth_radius_km, cell, ncols)
        return df.select("_g", "_r", F.explode(at).alias("_c")).select("_g", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), "_r")

    while not live.isEmpty():
        best = live.groupBy(*cells).agg(F.min("_r").alias("_best"))
        around = (touched(best.select("_g", F.col("_best").alias("_r"))).join(shuffled(best), cells)
                  .groupBy("_g", "_r").agg(F.min("_best").alias("_nearest")))
        kept.append(checkpoint_table(around.where("_r = _nearest").select("_g", "_r"), "kept"))
        near = touched(kept[-1]).withColumnRenamed("_r", "_k")
        close = haversine_km(F.col(f"k._k.{lat}"), F.col(f"k._k.{lon}"), F.col(f"l._r.{lat}"), F.col(f"l._r.{lon}"),
                             earth_radius_km) < min_km
        same = [F.col(f"l.{c}") == F.col(f"k.{c}") for c in cells]
        live = checkpoint_table(live.alias("l").join(shuffled(near).alias("k"), functools.reduce(lambda a, b: a & b, [*same, close]), "left_anti"), "places")
    unplaced = links.where(~placed)
    return functools.reduce(DataFrame.unionByName, [k.select("_r.*").select(*links.columns) for k in kept], unplaced)


def thin_within(points: DataFrame, rank: list[str], lat: str, lon: str, centers: DataFrame, center_lat: str, center_lon: str,
                radius_km: float, min_km: float, link_radius_km: float = SERVING_RADIUS_KM, earth_radius_km: float = SERVING_RADIUS_KM,
                distance_col: str = "distance_kilometers") -> DataFrame:
    """``thin_links`` of the pairs of ``within_distance_join`` (``link_radius_km``: its earth radius), without the pairs: a group for
    every row of ``centers``, in which ``distance_col`` ranks first, then ``rank``. The columns of both sides and the distance.
    """
    if min_km <= 0:
        return within_distance_join(points, lat, lon, centers, center_lat, center_lon, radius_km, link_radius_km, distance_col=distance_col)
    cell = max(math.degrees(min_km / earth_radius_km) / CELLS_ACROSS, MIN_CELL_DEG)
    nblocks = max(1, math.floor(360.0 / (cell * CELLS_ACROSS)))
    ncols, wide = nblocks * CELLS_ACROSS, 360.0 / nblocks
    cell = 360.0 / ncols
    # Distances order as these whole numbers do: up to 255 km a double of half a kilometer or more is a multiple of 2^-53 km, and
    # of two that differ by less the place first in ``rank`` goes first.
    scale = 2.0 ** (61 - max(8, math.ceil(math.log2(radius_km + 1))))
    # Of equal coordinates only the first in order can stay, whatever the center.
    order = [*rank, lat, lon]
    row = F.struct(*order, *[c for c in points.columns if c not in order])
    first = (points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon))
             .groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(F.min(row).alias("_r")))
    i, j = point_cell(F.col("_lat"), F.col("_lon"), cell, ncols)
    places = checkpoint_table(numbered(first, [F.col("_r").asc()], "_n").withColumns({"_i": i, "_j": j}), "places")
    sizes = checkpoint_table(places.groupBy("_i", "_j").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("long").alias("_salts")), "sizes")
    tasks = places.count() // SALTED
    places_at = checkpoint_table(places.join(shuffled(sizes), ["_i", "_j"]).select(
        "_i", "_j", F.pmod(F.xxhash64("_n"), F.col("_salts")).alias("_salt"), "_n", "_lat", "_lon"), "places")
    ctr = checkpoint_table(centers.where(F.col(center_lat).isNotNull() & F.col(center_lon).isNotNull())
                           .withColumn("_g", F.monotonically_increasing_id()), "thin_centers")

    def middle(i, j):
        la, lo = cell_middle(i, j, F.lit(cell))
        return F.least(la, F.lit(90.0)), lo

    mid_lat, mid_lon = middle("_i", "_j")
    reach = reach_of(F.lit(cell), mid_lat, earth_radius_km)
    farthest = 2 * earth_radius_km * math.radians(cell / 2) * (1 + 1e-9) + 1e-3
    live_at = sizes.withColumns({"_mlat": mid_lat, "_mlon": mid_lon})
    asked = within_distance_join(live_at, "_mlat", "_mlon", ctr.select("_g", F.col(center_lat).alias("_clat"), F.col(center_lon).alias("_clon")),
                                 "_clat", "_clon", radius_km + farthest * (link_radius_km / earth_radius_km + 1e-9), link_radius_km, distance_col="_d")
    none = F.array().cast("array<struct<lat:double,lon:double>>")
    cells, block = ["_g", "_i", "_j"], ["_g", "_bi", "_bj"]
    state = [*cells, "_bi", "_bj", "_clat", "_clon", "_salts"]
    asked = asked.withColumns({"_bi": F.floor(F.col("_i") / CELLS_ACROSS), "_bj": F.floor(F.col("_j") / CELLS_ACROSS)}).select(*state)

    def close(a_lat, a_lon, k):
        return haversine_km(k["lat"], k["lon"], a_lat, a_lon, earth_radius_km)

    def to_middle(k):
        return close(mid_lat, mid_lon, k)

    def scanned(asked, tasks=0):
        """The cells asked for that have a live place, with the order, number and coordinates of the nearest."""
        key = ["_i", "_j", "_salt"]
        a = asked.withColumn("_salt", F.explode(F.expr("sequence(0L, _salts - 1)")))
        b = places_at
        if tasks > a.sparkSession.sparkContext.defaultParallelism:
            a, b = a.repartition(tasks, *key), b.repartition(tasks, *key)
        km = haversine_km("_lat", "_lon", "_clat", "_clon", link_radius_km)
        met = a.join(shuffled(b), key).withColumn("_km", km).where(F.col("_km") <= radius_km)
        if "_near" in a.columns:
            met = met.where(~F.exists("_near", lambda k: close(F.col("_lat"), F.col("_lon"), k) < min_km))
        # Distance and number as one decimal: its minimum needs no sort, as that of a struct does.
        met = met.withColumn("_p", F.expr(f"cast(cast(floor(_km * {scale!r}D) AS decimal(19,0)) * {10 ** 19}BD + _n AS decimal(38,0))"))
        best = met.groupBy(*state).agg(F.min("_p").alias("_p"), *[F.min_by(c, "_p").alias(f"_best{c}") for c in ("_n", "_lat", "_lon")])
        return best.join(shuffled(asked.select(*cells, "_near")), cells) if "_near" in a.columns else best.withColumn("_near", none)

    # The expressions of a round, built once.
    best = ["_best_n", "_best_lat", "_best_lon"]
    touched = cap_cells(F.col("_best_lat"), F.col("_best_lon"), min_km, earth_radius_km, wide, nblocks)
    reached = cap_cells(F.col("lat"), F.col("lon"), min_km + farthest, earth_radius_km, wide, nblocks)
    measured = F.transform(F.coalesce("_new", none), lambda k: F.struct(k["lat"].alias("lat"), k["lon"].alias("lon"), to_middle(k).alias("km")))
    met_by = {"_new": F.filter(F.col("_new"), lambda k: k["km"] - F.col("_reach") < min_km)}
    judged = {"_covered": F.exists("_new", lambda k: k["km"] + F.col("_reach") < min_km),
              "_taken": F.exists("_new", lambda k: close(F.col("_best_lat"), F.col("_best_lon"), k) < min_km),
              "_near": F.concat("_near", F.transform("_new", lambda k: F.struct(k["lat"].alias("lat"), k["lon"].alias("lon"))))}
    kept = []
    live = checkpoint_table(scanned(asked, tasks), "cells")
    while not live.isEmpty():
        low = live.groupBy(*block).agg(F.min("_p").alias("_p"), *[F.min_by(c, "_p").alias(c) for c in best])
        around = low.select("_g", *best, F.col("_p").alias("_own"), F.explode(touched).alias("_c")).select(
            "_g", *best, "_own", F.col("_c.i").alias("_bi"), F.col("_c.j").alias("_bj"))
        lowest = around.join(shuffled(low.select(*block, "_p")), block).groupBy("_g", *best, "_own").agg(F.min("_p").alias("_p"))
        new = checkpoint_table(lowest.where("_p = _own").selectExpr("_g", "_best_n AS _n", "_best_lat AS lat", "_best_lon AS lon"), "kept")
        kept.append(new.select("_g", "_n"))
        over = (new.select("_g", F.struct("lat", "lon").alias("_k"), F.explode(reached).alias("_c"))
                .groupBy("_g", F.col("_c.i").alias("_bi"), F.col("_c.j").alias("_bj")).agg(F.collect_list("_k").alias("_new")))
        met = checkpoint_table(live.join(shuffled(over), block, "left").withColumns({"_new": measured, "_reach": reach}).withColumns(met_by)
                               .withColumns(judged).drop("_new", "_reach"), "cells")
        again = met.where("NOT _covered AND _taken").drop("_covered", "_taken", "_p", *best)
        live = checkpoint_table(met.where("NOT _covered AND NOT _taken").drop("_covered", "_taken").unionByName(scanned(again)), "cells")
    none_kept = live.select("_g", F.col("_best_n").alias("_n"))
    stay = functools.reduce(DataFrame.unionByName, kept, none_kept).join(shuffled(places.select("_n", "_r")), "_n").join(shuffled(ctr), "_g")
    km = haversine_km(F.col(f"_r.{lat}"), F.col(f"_r.{lon}"), center_lat, center_lon, link_radius_km)
    return stay.withColumn(distance_col, km).select(*[F.col(f"_r.{c}").alias(c) for c in points.columns], *centers.columns, distance_col)
