"""Training-corpus pipeline: quality rules, near duplicates, decontamination, secret masking and mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of their input; the last returns one row per copy that the mix
takes. Rows are handled as the stage's operator defines for nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deserta.llm import decontaminate, mixing, ngram_join, quality_rules, secret_scan
from deserta.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies (five words, similarity 0.8)."""
    return ngram_join.near_duplicates_dropped(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text masked."""
    out = secret_scan.without_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of the sources takes them."""
    return mixing.mixed(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("mixing sources", mix)]

#: The masking stage's model is fitted to the documents and has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
