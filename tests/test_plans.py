"""Plan-shape checks: no registered query plans a cross product."""

import pytest

from conftest import SF001
from deserta.plans.registry import spark_queries

_Q = spark_queries()


@pytest.mark.parametrize("name", sorted(_Q))
def test_no_cross_product(spark, name):
    plan = _Q[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
