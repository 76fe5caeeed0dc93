"""Facility directory -> capability table (C1-C3): one narrow projection stage per facility partition."""

from __future__ import annotations

from pyspark.sql import DataFrame

from deserta.operators.assess import assess_facilities, parse_assessment


def facility_capability(facilities: DataFrame, assessor=None) -> DataFrame:
    """Facility columns + data confidence + (capability, confidence, evidence, limitation) for five services."""
    return parse_assessment(assess_facilities(facilities, assessor))
