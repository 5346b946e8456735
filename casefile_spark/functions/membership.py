"""Which of some keys may be among many: Bloom filters per bucket, built and asked in Spark tasks.

Keys are 64-bit hashes dealt to buckets by hash, so no bucket is hot. A filter has ``BITS`` bits a key and answers "no" for
sure; "maybe" has to be confirmed (about one wrong in a thousand).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
PROBES = 6
FILTER = "bucket int, n long, bits binary"


def key_hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")  # another hash than the key's, whose bits the filter uses


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    keys = keys.astype(np.int64).view(np.uint64)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (keys[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)


def filter_bits(keys: np.ndarray) -> bytes:
    size = 1 << max(10, int(len(keys) * BITS - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_places(keys, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits, np.uint8)
    places = _places(keys, len(raw) * 8)
    return ((raw[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build(keys: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket over the column ``key`` (long)."""

    def work(group: pa.Table) -> pa.Table:
        values = np.unique(group["key"].to_numpy())
        return pa.table({"bucket": group["bucket"].slice(0, 1), "n": pa.array([len(values)]), "bits": pa.array([filter_bits(values)], pa.binary())})

    return keys.select("key", bucket_of(F.col("key"), buckets).alias("bucket")).distinct().groupBy("bucket").applyInArrow(work, FILTER)


def probe(filters: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """The distinct values of ``key`` that any filter of their bucket may hold, with their ``bucket``."""

    def work(held: pa.Table, asked: pa.Table) -> pa.Table:
        values, found = asked["key"].to_numpy(), np.zeros(len(asked), bool)
        for bits in held["bits"].to_pylist():
            found |= may_hold(bits, values)
        return asked.filter(pa.array(found))

    asked = keys.select("key", bucket_of(F.col("key"), buckets).alias("bucket")).distinct()
    return filters.select("bucket", "bits").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(work, "key long, bucket int")
