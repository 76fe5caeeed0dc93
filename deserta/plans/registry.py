"""Registered queries: name -> (Spark builder over an sf folder, DuckDB oracle SQL, double columns).

Every query reads the whole test-data tables (through the fixture mappings) so its work grows with them. Double
outputs are rounded to 6 decimals in both engines with the same ``floor(x * 1e6 + 0.5) / 1e6`` arithmetic, since
averages and trig results may differ in the last bits between engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType

SCALE = 1000000.0


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, doubles=()):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql, tuple(doubles))
        return fn
    return deco


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (one projection built from SQL text)."""
    items = []
    for f in df.schema.fields:
        q = f"`{f.name}`"
        items.append(f"floor({q} * {SCALE}D + 0.5D) / {SCALE}D AS {q}" if isinstance(f.dataType, DoubleType) else q)
    return df.selectExpr(*items)


def oracle_text(q: Query) -> str:
    if not q.doubles:
        return q.sql
    rep = ", ".join(f"floor({c} * {SCALE} + 0.5) / {SCALE} AS {c}" for c in q.doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({q.sql}) oracle_q"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def wrap(fn):
        return lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))

    return {name: wrap(q.build) for name, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load()
    return {name: oracle_text(q) for name, q in REGISTRY.items() if q.sql is not None}


def _load():
    # Importing the modules registers their queries.
    from deserta.plans import queries  # noqa: F401
