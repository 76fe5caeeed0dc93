"""Connected components of an edge table by contraction.

In each round every node moves to the first of its neighbours and itself in an order that is drawn anew by a hash; the edges
are then drawn between the places moved to, loops and repeats are dropped, and the moves are added to those of
earlier rounds. With a random order a fixed share of the places vanishes per round, so a path of n nodes takes about
log n rounds. A round is a grouped minimum (summed map-side, so a node with very many edges is never gathered) and joins on
keys; it is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deserta.sources.tables import checkpoint_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges, in either direction; a component is named by its smallest node."""
    links = checkpoint_table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
                             .distinct(), "links")
    place = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node"))
    links, number = links.where("a <> b"), 0
    while not links.isEmpty():
        def order(c, n=number):
            return F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("to"))

        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = checkpoint_table(both.groupBy("a").agg(F.min(order("b")).alias("m"))
                                 .select(F.col("a").alias("at"), F.least("m", order("a")).getField("to").alias("to")), "moves")
        place = checkpoint_table(place.join(moves, "at", "left").select("node", F.coalesce("to", "at").alias("at")), "places")
        moved = links.join(moves.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
        moved = moved.join(moves.select(F.col("at").alias("b"), F.col("to").alias("y")), "b")
        links = checkpoint_table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                                 .where("a <> b").distinct(), "links")
        number += 1
    names = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(names, "at").select("node", "component")
