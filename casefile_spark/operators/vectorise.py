"""Text vectors on Spark alone, for a text query against a text corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 1_000


@dataclass(frozen=True)
class Vectoriser:
    """Inverse document frequency per hash bucket; as long as the vectors, whatever the corpus."""

    idf: tuple[float, ...]


def _buckets(text: Column, dim: int) -> Column:
    """The hash bucket of every word of two or more characters, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: F.length(w) >= 2)
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))


def fit_vectoriser(corpus: DataFrame, text: str = "text", dim: int = 1024) -> Vectoriser:
    """One pass over the texts; ``dim`` counts reach the driver."""
    found = corpus.select(F.explode_outer(F.array_distinct(_buckets(F.col(text), dim))).alias("b"))
    held = {r.b: r.n for r in found.filter("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n")).collect()}
    texts = corpus.count()
    return Vectoriser(tuple(float(np.log((texts + 1) / (held[b] + 1))) if b in held else 0.0 for b in range(dim)))


def save(model: Vectoriser, spark: SparkSession, folder: str) -> None:
    """Keep a fitted vectoriser as a table of buckets and weights; buckets no text has are left out."""
    rows = [(b, w) for b, w in enumerate(model.idf) if w]
    spark.createDataFrame([(len(model.idf), rows)], "dim int, weights array<struct<bucket: int, idf: double>>").write.parquet(folder)


def load(spark: SparkSession, folder: str) -> Vectoriser:
    row = spark.read.parquet(folder).first()
    held = {r["bucket"]: r["idf"] for r in row["weights"]}
    return Vectoriser(tuple(held.get(b, 0.0) for b in range(row["dim"])))


def vectorise(model: Vectoriser, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
    """Word counts per bucket times their weight, unit length; a text without known words stays zero.

    The texts of a batch are counted together, ``TILE`` rows at a time.
    """
    dim = len(model.idf)

    @F.arrow_udf("array<double>")
    def weighted(buckets: pa.Array) -> pa.Array:
        idf, done = np.array(model.idf), np.empty((len(buckets), dim))
        for lo in range(0, len(buckets), TILE):
            some = buckets.slice(lo, TILE)
            row = np.repeat(np.arange(len(some)), np.diff(some.offsets.to_numpy()))
            v = np.bincount(row * dim + some.flatten().to_numpy(), minlength=len(some) * dim).reshape(-1, dim) * idf
            length = np.sqrt((v * v).sum(axis=1))
            done[lo : lo + TILE] = v / np.where(length == 0, 1.0, length)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * dim), pa.array(done.reshape(-1)))

    return df.withColumn(out, weighted(_buckets(F.col(text), dim)))
