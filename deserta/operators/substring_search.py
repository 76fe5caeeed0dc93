"""F2 by index: many substring searches over a table of names at once, without scanning the names once per search.

The index lists the distinct runs of one to three characters (grams) of every distinct name, in lower case, and the empty gram. A
search looks up the ``RAREST`` of its own grams, three characters long or as long as the search itself; only names that hold all
of these are compared with ``contains``. Shorter and empty searches have their grams in the index too, so nothing is scanned.
All joins are equi-joins on a gram; a gram that many names hold is read only by a search that has no rarer one.

Searches are trimmed and compared without case. An empty search finds every name; null names are never found, null searches
find nothing; repeated names and searches give their rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Grams of a search that candidates must hold; further ones would cost more reading than they save.
RAREST = 3


def _grams(text: str, sizes: str) -> str:
    """SQL: the distinct runs of each of the sizes in a text."""
    runs = f"transform(sequence(1, length({text}) - z + 1), i -> substring({text}, i, z))"
    return f"array_distinct(flatten(transform(filter({sizes}, z -> z <= length({text})), z -> CASE WHEN z = 0 THEN array('') ELSE {runs} END)))"


def gram_index(names: DataFrame, name_col: str) -> DataFrame:
    """(gram, name) of every distinct name, name in lower case: a table to write once and search often."""
    low = names.select(F.lower(F.col(name_col)).alias("name")).where("name IS NOT NULL").distinct()
    sizes = ", ".join(str(z) for z in range(GRAM + 1))
    return low.select(F.explode(F.expr(_grams("name", f"array({sizes})"))).alias("gram"), "name")


def search(index: DataFrame, searches: DataFrame, search_col: str) -> DataFrame:
    """(search_col, name): the lower-case names that contain each distinct search."""
    asked = searches.select(search_col).where(F.col(search_col).isNotNull()).distinct().withColumn("_s", F.lower(F.trim(search_col)))
    grams = asked.select(search_col, "_s", F.explode(F.expr(_grams("_s", f"array(least(length(_s), {GRAM}))"))).alias("gram"))
    held = index.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = F.slice(F.sort_array(F.collect_list(F.struct("n", "gram"))), 1, RAREST)  # at most the length of a search
    chosen = (grams.join(held, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
              .groupBy(search_col, "_s").agg(by_rarity.alias("r")))
    asked_grams = chosen.select(search_col, "_s", F.size("r").alias("_want"), F.explode("r.gram").alias("gram"))
    found = asked_grams.join(index, "gram").groupBy(search_col, "_s", "_want", "name").agg(F.count(F.lit(1)).alias("_has"))
    return found.where("_has = _want").where(F.col("name").contains(F.col("_s"))).select(search_col, "name")


def rows_found(rows: DataFrame, name_col: str, searches: DataFrame, search_col: str, index: DataFrame | None = None) -> DataFrame:
    """All rows of ``rows`` with each row of ``searches`` whose text their name contains."""
    hits = search(gram_index(rows, name_col) if index is None else index, searches, search_col)
    return (rows.withColumn("_name", F.lower(F.col(name_col))).join(hits.withColumnRenamed("name", "_name"), "_name")
            .join(searches, search_col).drop("_name"))
