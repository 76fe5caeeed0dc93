"""Mixing sources to target weights.

Words are counted per document and summed per source; the targets share all words by weight, none above ``max_repeat``
times its source (water-filling, in closed form); each document is then emitted floor(rate) times plus one more copy if
a hash-seeded coin falls below the rate's fraction, so a rerun takes the same copies.

Only DataFrame operations. The per-source table has one row per source and is the only thing that is windowed; documents
are never grouped into one task and a source's sums are pre-aggregated before the shuffle. The join with the documents is
left to adaptive execution, which broadcasts the source table only if its measured size is below the session's limit.

Defined cases: a null text has 0 words; a null source is a source of its own, last in order; a source without words gets
target 0 and no copies; repeated rows are mixed as equal documents; null ids toss the coin of the id ``null``; an empty
table gives an empty result; input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has source and size.

    With caps c = max_repeat * size sorted by c / weight, the capped sources are a prefix of that order: the first k with
    level(k) * weight(k + 1) <= c(k + 1), level(k) being the words left for the others over their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    caps = per.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = caps.withColumn("left", left).withColumn("others", others)
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("others")
    at = F.min_by(F.when(fits, F.struct("left", "others")), F.when(fits, F.struct(F.col("cap") / F.col("w"), "source_nulls",
                                                                                 "source"))).over(whole)
    level = level.withColumn("source_nulls", F.col("source").isNull()).withColumn("at", at)
    share = F.col("at.left") * F.col("w") / F.col("at.others")
    target = F.least(F.col("cap").cast("double"), F.coalesce(share, F.lit(0.0)))
    return level.select("source", "source_size", target.alias("target"))


def coin(id_col, seed: str = "mix"):
    """Uniform in [0, 1) from the id and the seed, the same in every run."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def with_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``df`` with size, source_size, target and copies (how often the mix takes the document)."""
    made = ("size", "source_size", "target", "copies")
    base = df.select(*[c for c in df.columns if c not in made])
    sized = base.withColumn("size", n_words(F.col(text_col)))
    targets = source_targets(base.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")),
                             weights, max_repeat).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized[source_col].eqNullSafe(targets["__source"]), "inner")
    copies = F.floor(rate) + (coin(F.col(id_col)) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies).drop("__source")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, with its columns."""
    took = with_copies(df, id_col, text_col, source_col, **more).where(F.col("copies") > 0)
    return took.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*df.columns)


def mix_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken (words that the mix takes of the document) of every document."""
    took = with_copies(df.select(*dict.fromkeys((id_col, text_col, source_col))), id_col, text_col, source_col)
    return took.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size,
               [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
        FROM s GROUP BY source),
lv AS (SELECT *, 3 * source_size AS cap,
              (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::BIGINT AS lft,
              (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS others
       FROM per WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT lft, others FROM lv WHERE lft * w <= cap * others ORDER BY cap / w::DOUBLE, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (lvl.lft * w)::DOUBLE / lvl.others::DOUBLE) AS target FROM lv, lvl),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 12))::BIGINT
          / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
