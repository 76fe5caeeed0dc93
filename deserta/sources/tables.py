"""Scans and sinks.

Reads are plain ``spark.read`` so Catalyst pushes filters and column pruning into the parquet scan. Writes are
full-refresh overwrites, like the reference's materialized views.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TESTDATA_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                   "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scan_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S1 for files: one parquet table under ``sf_dir``; splits follow ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scan_table(spark: SparkSession, name: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A catalog table by name, or a path when given."""
    if path is None:
        return spark.read.table(name)
    return spark.read.format(fmt).load(path)


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """S3: register a session-scoped view and return the DataFrame unchanged."""
    df.createOrReplaceTempView(name)
    return df


def materialize(df: DataFrame, path: str, schema_ddl: str | None = None, partition_by: list[str] | None = None,
                comment: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Full-refresh write of a named output; optionally conformed to a DDL schema first.

    Returns a DataFrame that reads the written files back, which also cuts the lineage: a lost executor after this
    point recomputes from the files, not from the sources. Zstandard: a served table is written once and read often.
    """
    from deserta.operators.quality import conform_schema

    out = conform_schema(df, schema_ddl) if schema_ddl else df
    if comment:  # kept in the files' schema, where every reader of the table finds it
        first = out.schema.fields[0].name
        out = out.withMetadata(first, {**out.schema[first].metadata, "table_comment": comment})
    writer = out.write.mode(mode).format("parquet").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return out.sparkSession.read.parquet(path)


SERVED_TABLES = ("care_desert_indicators", "facility_district_distances", "facility_locations",
                 "healthcare_master_view", "facility_capability")


def scan_served(spark: SparkSession, root: str, names=SERVED_TABLES) -> dict[str, DataFrame]:
    """Read the served tables written under ``root`` and register each as a temp view."""
    out = {}
    for n in names:
        out[n] = temp_view(spark.read.parquet(os.path.join(root, n)), n)
    return out


def planning_json(df: DataFrame) -> DataFrame:
    """One JSON document per row (``value`` column), ready for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def checkpoint_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as a parquet table under the session's checkpoint folder (``spark.checkpoint.dir``, a
    shared path on a cluster) and return a DataFrame reading it back.

    Cuts the lineage (a lost executor recomputes from the files, not the sources), computes ``df`` exactly once
    (an RDD checkpoint would run the plan a second time to write it), and later readers get column pruning and
    filter pushdown from the parquet scan.
    """
    import uuid

    from deserta.session import ensure_checkpoint_dir

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. A written table's size is taken from its compressed files and an
    exploded one's from its rows before, so a side that grows with the data can be a hundred times what the planner takes it
    for, all of it collected on the driver. Adaptive execution still divides skewed partitions of the join."""
    return df.hint("merge")


def checkpoint_tables(named: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``checkpoint_table`` for several independent DataFrames, submitted as concurrent Spark jobs (one driver
    thread each), so a small table's job fills the slots a large one leaves idle."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, len(named))) as pool:
        futures = {k: pool.submit(checkpoint_table, df, k) for k, df in named.items()}
        return {k: f.result() for k, f in futures.items()}
