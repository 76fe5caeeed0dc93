"""Incremental refresh of the indicator table with Structured Streaming.

The reference refreshes its views in full. Survey → indicators is a stateless, row-local projection, so the same
plan runs unchanged on a file stream: each new batch of raw survey files becomes new indicator rows. No state, no
watermark; exactly-once comes from the checkpoint folder plus the file sink's commit log, and a lost executor
replays only the micro-batch in flight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from deserta.plans.indicators import care_desert_indicators, nfhs_cleaned


def indicator_stream(spark: SparkSession, source_dir: str, raw_schema: StructType,
                     max_files_per_trigger: int | None = None, allow_missing: bool = False) -> DataFrame:
    """Streaming DataFrame of indicator rows over parquet survey files arriving in ``source_dir``."""
    reader = spark.readStream.schema(raw_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return care_desert_indicators(nfhs_cleaned(reader.parquet(source_dir), allow_missing))


def refresh_indicators(spark: SparkSession, source_dir: str, raw_schema: StructType, sink_dir: str,
                       checkpoint_dir: str, available_now: bool = True, allow_missing: bool = False) -> StreamingQuery:
    """Append new indicator rows to a parquet table; ``available_now`` processes what is there and stops."""
    writer = (indicator_stream(spark, source_dir, raw_schema, allow_missing=allow_missing).writeStream.format("parquet")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
