"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    v = as_double(v)
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    a, b = as_double(a), as_double(b)
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def centroids(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key, aggregated component-wise so that map-side combine applies."""
    return (
        df.select(key, F.posexplode(vec).alias("_i", "_x"))
        .groupBy(key, "_i")
        .agg(F.avg(F.col("_x").cast("double")).alias("_m"))
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vec))
    )
