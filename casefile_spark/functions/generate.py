"""Generators over computed arrays.

For a plain explode the optimizer adds "the array is not empty" below the projection that computes
the array, so a costly array is computed again, several times over, only to be tested. The outer
form is not rewritten; the one empty row it adds is filtered on the generated column instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, items: Column, value: str, pos: str = "_pos") -> DataFrame:
    """keep..., position from 0, element; no row for an empty or NULL array."""
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, value)).filter(F.col(pos).isNotNull())
    return rows.drop("_pos") if pos == "_pos" else rows


def inline_rows(df: DataFrame, keep: list, items: Column, required: str) -> DataFrame:
    """keep... and the fields of every struct; ``required`` names a field that is never NULL."""
    return df.select(*keep, F.inline_outer(items)).filter(F.col(required).isNotNull())
