"""Data-quality operators (V1-V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def key_violations(df: DataFrame, keys: list[str], not_null: list[str] | None = None) -> DataFrame:
    """V1: rows that break NOT NULL on ``not_null`` or the primary key ``keys``.

    Output: keys, ``row_count`` (rows sharing the key) and ``violation`` ('null_key' or 'duplicate_key').
    One aggregation with map-side partial counts; a hot key costs one counter, not a collected group.
    """
    not_null = not_null if not_null is not None else keys
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    null_any = F.lit(False)
    for c in not_null:
        null_any = null_any | F.col(c).isNull()
    return (
        counted.withColumn(
            "violation",
            F.when(null_any, F.lit("null_key")).when(F.col("row_count") > 1, F.lit("duplicate_key")),
        )
        .filter(F.col("violation").isNotNull())
    )


def conform_schema(df: DataFrame, ddl: str | StructType) -> DataFrame:
    """V2: select the declared columns in declared order, try-cast to the declared types.

    Missing columns become typed NULLs. NOT NULL is audited by ``key_violations``, not silently enforced.
    """
    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            src = F.col(f.name)
            cols.append((src if df.schema[f.name].dataType == f.dataType else src.try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
