"""Rendering of typed sheet cells to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_timestamp(ts: Column) -> Column:
    """Midnight reads as a date; otherwise date and time, with microseconds only when present."""
    whole = F.date_trunc("second", ts) == ts
    return (
        F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "yyyy-MM-dd"))
        .when(whole, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


def render_number(x: Column) -> Column:
    """Whole numbers without a fraction; others with their shortest digits, never in powers of ten."""
    digits = x.cast("string")
    plain = F.regexp_replace(digits.cast("decimal(38,16)").cast("string"), r"0+$", "")
    ordinary = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).when(ordinary, digits).otherwise(plain)


def render_cell(kind: Column, text: Column, number: Column, ts: Column) -> Column:
    """kind is one of text, number, timestamp; an empty cell renders as ''."""
    shown = (
        F.when(kind == "timestamp", render_timestamp(ts))
        .when(kind == "number", render_number(number))
        .otherwise(F.trim(text))
    )
    return F.coalesce(shown, F.lit(""))
