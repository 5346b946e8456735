"""Exact cosine top-k without a cross join.

The query side is small by nature. While it stays within a checked row bound its vectors travel to
the tasks with the function; every Arrow batch of the corpus is scored by one matrix product
and only its own best k rows per query leave the task. Beyond the bound both sides are cut into
hashed blocks and each (corpus block, query block) cell is one bounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 4096  # at 1,024 dimensions this is 32 MB of doubles per task
SCORE_DIGITS = 12
MIXED_SIZES = "query vectors differ in size"
SCORE_ROWS = 2_000  # vectors of a batch that are copied, normalised and scored at once
TILE_CELLS = 4_000_000  # scores held at once by a task: 32 MB of doubles


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return m / n


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the earlier position."""
    if scores.size > k:
        floor = np.partition(scores, scores.size - k)[scores.size - k]
        cand = np.flatnonzero(scores >= floor)
    else:
        cand = np.arange(scores.size)
    return cand[np.argsort(-scores[cand], kind="stable")][:k]


def _score_table(table: pa.Table, query_ids: np.ndarray, units: np.ndarray, k, grouped: bool) -> pa.Table:
    dim = units.shape[1]
    order = pc.sort_indices(
        table, sort_keys=[("collection_pos", "ascending"), ("chunk_no", "ascending"), ("chunk_key", "ascending")]
    )
    table = table.take(order).combine_chunks()
    corpus = _unit(_matrix(table["embedding"].combine_chunks(), dim))
    pos = table["collection_pos"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(pos)) + 1).tolist(), len(pos)] if grouped else [0, len(pos)]
    rows, owners, depths, values = [], [], [], []
    tile = max(1, TILE_CELLS // max(1, len(pos)))
    for first in range(0, units.shape[0], tile):
        scores = np.round(units[first : first + tile] @ corpus.T, SCORE_DIGITS)
        for q, row in enumerate(scores, first):
            for lo, hi in zip(cuts, cuts[1:]):
                best = _best(row[lo:hi], int(k[q])) + lo
                rows.append(best)
                owners.append(np.full(best.size, query_ids[q]))
                depths.append(np.full(best.size, k[q]))
                values.append(row[best])
    picked = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    out = table.select(["collection", "collection_pos", "chunk_no", "chunk_key"]).take(pa.array(picked))
    return pa.table(
        {
            "query_id": pa.array(np.concatenate(owners) if owners else [], pa.int64()),
            "k": pa.array(np.concatenate(depths) if depths else [], pa.int64()),
            "score": pa.array(np.concatenate(values) if values else [], pa.float64()),
            "collection": out["collection"].cast(pa.string()),
            "collection_pos": out["collection_pos"].cast(pa.int64()),
            "chunk_no": out["chunk_no"].cast(pa.int64()),
            "chunk_key": out["chunk_key"].cast(pa.string()),
        }
    )


_OUT = "query_id long, k long, score double, collection string, collection_pos long, chunk_no long, chunk_key string"
_IN = ["collection", "collection_pos", "chunk_no", "chunk_key", "embedding"]


def _candidates_resident(corpus: DataFrame, ids, units, ks, grouped: bool) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SCORE_ROWS):
                yield from _score_table(pa.Table.from_batches([batch.slice(lo, SCORE_ROWS)]), ids, units, ks, grouped).to_batches()

    return corpus.select(*_IN).mapInArrow(score, _OUT)


def _candidates_blocked(corpus, queries, dim: int, queries_per_block: int, rows_per_block: int, grouped: bool):
    n_qblocks = max(1, math.ceil(queries.count() / queries_per_block))
    n_cblocks = max(1, math.ceil(corpus.count() / rows_per_block))
    left = (
        corpus.select(*_IN, F.pmod(F.xxhash64("chunk_key"), F.lit(n_cblocks)).alias("_c"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_qblocks - 1).cast("long"))))
    )
    right = (
        queries.select("query_id", "k", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_qblocks)).alias("_q"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cblocks - 1).cast("long"))))
    )

    def cell(chunks: pa.Table, wanted: pa.Table) -> pa.Table:
        wanted = wanted.combine_chunks()
        ids = wanted["query_id"].to_numpy()
        if not chunks.num_rows or not len(ids):
            return pa.schema([
                ("query_id", pa.int64()), ("k", pa.int64()), ("score", pa.float64()), ("collection", pa.string()),
                ("collection_pos", pa.int64()), ("chunk_no", pa.int64()), ("chunk_key", pa.string()),
            ]).empty_table()
        units = _unit(_matrix(wanted["embedding"].combine_chunks(), dim))
        return _score_table(chunks, ids, units, wanted["k"].to_numpy(), grouped)

    return left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(cell, _OUT)


def cosine_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    per_collection: bool = False,
    max_queries: int = MAX_QUERIES,
    rows_per_block: int = 200_000,
) -> DataFrame:
    """Best k chunks per query (or per query and collection), exact, ties by collection then chunk.

    corpus: collection, collection_pos, chunk_no, chunk_key, embedding.
    queries: query_id, k, embedding; all of one size, otherwise the job fails. Vectors of another
    size cannot be compared and are no hits; ``retrieval.readable`` tells which collections have none.
    Returns query_id, rank, score, collection, collection_pos, chunk_no, chunk_key.
    """
    queries = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("k").cast("long").alias("k"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    head = queries.limit(max_queries + 1).toArrow()  # checked size: at most max_queries + 1 rows
    dim = len(head["embedding"][0]) if head.num_rows else 1
    size = F.size("embedding")
    queries = queries.withColumn(
        "embedding", F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(MIXED_SIZES)).cast("array<double>"))
    )
    if any(len(v) != dim for v in head["embedding"]):
        raise ValueError(MIXED_SIZES)
    corpus = corpus.filter(F.size("embedding") == dim).select(
        F.col("collection").cast("string").alias("collection"),
        F.col("collection_pos").cast("long").alias("collection_pos"),
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.col("chunk_key").cast("string").alias("chunk_key"),
        "embedding",
    )
    if head.num_rows <= max_queries:
        ids, ks = head["query_id"].to_numpy(), head["k"].to_numpy()
        units = _unit(_matrix(head["embedding"].combine_chunks(), dim)) if len(ids) else np.zeros((0, dim))
        cand = _candidates_resident(corpus, ids, units, ks, per_collection)
        deepest = int(ks.max()) if len(ks) else 0
    else:
        cand = _candidates_blocked(corpus, queries, dim, max_queries, rows_per_block, per_collection)
        deepest = int(queries.agg(F.max("k")).first()[0])
    keys = ["query_id", "collection"] if per_collection else ["query_id"]
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "collection_pos", "chunk_no", "chunk_key")
    # The constant bound lets the window limit run before the shuffle; each query then keeps its own k.
    return (
        cand.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= deepest)
        .filter(F.col("rank") <= F.col("k"))
        .select("query_id", "rank", "score", "collection", "collection_pos", "chunk_no", "chunk_key")
    )
