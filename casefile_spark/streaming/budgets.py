"""Daily call budget as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import budget_state


def daily_budget(calls: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Calls per UTC day with the budget state; rows later than the watermark are dropped."""
    return (
        calls.withWatermark(at, late)
        .groupBy(F.window(at, "1 day").alias("_w"))
        .agg(F.count("*").alias("calls"))
        .select(F.to_date("_w.start").alias("day"), "calls", budget_state(F.col("calls")).alias("state"))
    )
