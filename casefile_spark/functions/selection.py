"""Exact quantiles by repeated histograms: no task and no buffer ever holds the values.

Each round cuts the interval that a wanted rank lies in into ``CELLS`` equal cells and takes count, least and largest value of
each (partial aggregates in the tasks, at most ``CELLS`` rows an interval afterwards). The rank's cell, from its least to its
largest value, is the next interval; it ends when both are equal. The ends of an interval never share a cell, so every round
narrows it, about ``CELLS`` times. The rounds depend on the spread of the values, not on the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1024


def values_at(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of the ascending non-null values; NaN counts as no value."""
    x = F.col(column).cast("double")
    held = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    lo, hi = held.agg(F.min("x"), F.max("x")).first()
    open_, found = {r: (lo, hi, 0) for r in ranks}, {}
    while open_:
        for r, (a, b, _) in [*open_.items()]:
            if a == b:
                found[r] = a
                del open_[r]
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        if not spans:
            break
        number, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(spans):  # halves, since a difference may exceed the largest double
            inside = (F.col("x") >= F.lit(a)) & (F.col("x") <= F.lit(b))
            share = (F.col("x") / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2)
            number = F.when(inside, i).otherwise(number)
            cell = F.when(inside, F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")).otherwise(cell)
        counted = held.select("x", number.alias("span"), cell.alias("cell")).filter("span IS NOT NULL").groupBy("span", "cell")
        cells = counted.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r, (a, b, below) in [*open_.items()]:
            for c in sorted((c for c in cells if c["span"] == spans.index((a, b))), key=lambda c: c["cell"]):
                if r < below + c["n"]:
                    open_[r] = (c["low"], c["high"], below)
                    break
                below += c["n"]
    return found


def quantiles(df: DataFrame, column: str, **shares: float) -> DataFrame:
    """One row with the quantiles at the given shares, interpolated between neighbours; null where there is no value."""
    held = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n = held.count()
    at = {name: share * (n - 1) for name, share in shares.items()}
    found = values_at(held, "x", sorted({f(p) for p in at.values() for f in (math.floor, math.ceil)})) if n else {}
    row = []
    for p in at.values():
        low, high = (found.get(f(p)) for f in (math.floor, math.ceil))
        row.append(None if low is None else low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{name} double" for name in shares))
