"""Writing decisions as the response documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decision_json(decisions: DataFrame) -> DataFrame:
    """query_id and the response body ``{"approved":..,"fraud_score":..}``."""
    body = F.to_json(F.struct("approved", "fraud_score"))
    return decisions.select("query_id", body.alias("value"))


def write_decisions(decisions: DataFrame, path: str, mode: str = "append") -> None:
    """One response document per line, keyed by query_id."""
    decisions.select("query_id", "approved", "fraud_score").write.mode(mode).json(path)
