"""Proximity clusters of map points.

A point is a circle on the Web-Mercator pixel plane whose radius follows its impact. Circles that touch (their distance is at
most the sum of the radii and ``GAP``) belong together; a cluster is again a circle, at the weighted mean position of its
members and with the radius of their summed impact, so clusters may touch after they have formed. A pass merges

1. the circles of one small cell. Its diagonal is the distance at which even the smallest circles touch, so all of them do;
   afterwards a cell holds one circle, and the number of neighbours of a circle is bounded, whatever the density;
2. the connected components of the circles that touch, found by an equi-join of each circle with the cells around it.

Passes repeat until no two circles touch. Positions and weights are summed as integers (1e-7 degree, 1e-3), so the clusters
do not depend on the order of rows or the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deserta.functions.geo import mercator_pixels
from deserta.operators.components import connected_components
from deserta.sources.tables import checkpoint_table

# Smallest and largest radius, base and factor of the radius, pixels between circles that still touch.
MIN_RADIUS, MAX_RADIUS, BASE_RADIUS, RADIUS_FACTOR, GAP = 7.0, 26.0, 6.0, 0.05, 2.0
#: Side of a cell whose diagonal is the distance of two smallest circles that touch (a little less, for rounding).
CELL = (2 * MIN_RADIUS + GAP) / 2 ** 0.5 * (1 - 1e-9)
#: Cells that a touching circle may be away.
REACH = int((2 * MAX_RADIUS + GAP) / CELL) + 1


def impact_radius(impact: Column) -> Column:
    grown = F.lit(BASE_RADIUS) + F.sqrt(F.greatest(impact, F.lit(1.0))) * RADIUS_FACTOR
    return F.greatest(F.lit(MIN_RADIUS), F.least(F.lit(MAX_RADIUS), grown))


def _whole(c: Column, scale: float, digits: int) -> Column:
    return F.round(c * scale).cast(f"decimal({digits},0)")


def first_circles(points: DataFrame, id_col: str = "id", lon: str = "longitude", lat: str = "latitude",
                  impact: str = "population_impact") -> DataFrame:
    """(cluster, impact, w, wlon, wlat): a circle per id, of exact sums. Points of equal id are one circle; points without an
    id or position have none; a missing impact is none."""
    known = F.coalesce(F.col(impact), F.lit(0.0))
    w = _whole(F.greatest(known, F.lit(1.0)), 1e3, 18)
    at = points.where(F.col(id_col).isNotNull() & F.col(lon).isNotNull() & F.col(lat).isNotNull()
                      & ~F.isnan(F.col(lon).cast("double")) & ~F.isnan(F.col(lat).cast("double")))
    return _summed(at.select(F.col(id_col).alias("cluster"), _whole(known, 1e3, 18).alias("impact"), w.alias("w"),
                             (_whole(F.col(lon), 1e7, 10) * w).cast("decimal(38,0)").alias("wlon"),
                             (_whole(F.col(lat), 1e7, 10) * w).cast("decimal(38,0)").alias("wlat")), "cluster")


def _summed(circles: DataFrame, key: str) -> DataFrame:
    return circles.groupBy(F.col(key).alias("cluster")).agg(
        *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("impact", "w", "wlon", "wlat")])


def placed(circles: DataFrame, zoom: float) -> DataFrame:
    """The circles with pixel position x, y, radius and cell."""
    lon, lat = (F.col(c).cast("double") / F.col("w").cast("double") / 1e7 for c in ("wlon", "wlat"))
    x, y = mercator_pixels(lon, lat, zoom)
    return (circles.withColumns({"x": x, "y": y, "radius": impact_radius(F.col("impact").cast("double") / 1e3)})
            .withColumns({"cx": F.floor(F.col("x") / CELL), "cy": F.floor(F.col("y") / CELL)}))


def touching(circles: DataFrame) -> DataFrame:
    """(a, b) of placed circles that touch, each pair once. No more than one circle stands in a cell."""
    side = circles.select("cluster", "x", "y", "radius", "cx", "cy")
    steps = F.array([F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for dx in range(-REACH, REACH + 1) for dy in range(-REACH, REACH + 1) if (dx, dy) > (0, 0)])
    around = side.withColumn("step", F.explode(steps)).select(
        F.col("cluster").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("radius").alias("ar"),
        (F.col("cx") + F.col("step.dx")).alias("cx"), (F.col("cy") + F.col("step.dy")).alias("cy"))
    return (around.join(side, ["cx", "cy"])
            .where(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")) <= F.col("ar") + F.col("radius") + GAP)
            .select("a", F.col("cluster").alias("b")))


def proximity_clusters(points: DataFrame, zoom: float = 4.0, id_col: str = "id", lon: str = "longitude",
                       lat: str = "latitude", impact: str = "population_impact") -> DataFrame:
    """(id, cluster_key) of every point with a position; a cluster is named by its smallest id."""
    circles = checkpoint_table(first_circles(points, id_col, lon, lat, impact), "circles")
    member = circles.select(F.col("cluster").alias(id_col), "cluster")

    def renamed(names: DataFrame) -> None:
        """Merges circles by ``names`` (cluster, into), which lists those whose name changes."""
        nonlocal circles, member
        member = checkpoint_table(member.join(names, "cluster", "left").select(id_col, F.coalesce("into", "cluster").alias("cluster")),
                                  "members")
        circles = checkpoint_table(_summed(circles.join(names, "cluster", "left").withColumn("into", F.coalesce("into", "cluster")),
                                           "into"), "circles")

    while True:
        at = placed(circles, zoom).select("cluster", "cx", "cy")
        first = at.groupBy("cx", "cy").agg(F.min("cluster").alias("into"), F.count("*").alias("n")).where("n > 1")
        same = checkpoint_table(at.join(first.select("cx", "cy", "into"), ["cx", "cy"]).where("cluster <> into")
                                .select("cluster", "into"), "cells")
        if not same.isEmpty():
            renamed(same)
            continue  # a merged circle may have moved into the next cell
        links = checkpoint_table(touching(placed(circles, zoom)), "touching")
        if links.isEmpty():
            return member.withColumnRenamed("cluster", "cluster_key")
        renamed(connected_components(links).where("node <> component")
                .select(F.col("node").alias("cluster"), F.col("component").alias("into")))
