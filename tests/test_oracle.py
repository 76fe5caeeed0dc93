"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate, run locally)."""

import pytest

import __spark_entry__ as E
from conftest import SF01, assert_same
from deserta.plans.registry import oracle_queries, spark_queries

_Q = spark_queries()
_O = oracle_queries()


@pytest.mark.parametrize("name", sorted(_O))
def test_query_matches_oracle(spark, duck01, name):
    assert_same(_Q[name](spark, SF01), duck01.sql(_O[name]).df())


def test_every_query_has_registered_doubles(spark):
    from deserta.plans.registry import REGISTRY
    from pyspark.sql.types import DoubleType

    for name, q in REGISTRY.items():
        if q.sql is None:
            continue
        df = q.build(spark, "/root/testdata/sf0.001")
        doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
        assert doubles == set(q.doubles), (name, doubles ^ set(q.doubles))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
