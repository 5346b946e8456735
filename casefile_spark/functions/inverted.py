"""A positional inverted index in blocks, and ranked search over it with score bounds.

The index is a table, one row per block and term: the places in the block of the documents that hold the term, how often, at
which word positions, and the largest count; one more row per block lists its documents. Documents enter blocks in the order of their length within the task that read them, so
texts are not shuffled, and long documents, which score high, share blocks.

A search joins the index to the asked terms only. Blocks of one part and a slice of the queries meet in one task: a block's
bound for a query is the sum over its terms of weight times largest count; blocks come in falling order of their words, and
one whose bound is below the query's k-th score so far is not scored. Phrases are found from positions. What leaves a task is
at most k rows a query, so there is never a row per document and query, whatever the number of queries or phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 256
PART_WORDS = 1_000_000
SLICE_QUERIES = 512
#: Beside its terms, a block has one row under this name (never a term) with all its documents.
ALL = ""


def _flat(array: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of lists and their values end to end."""
    return np.diff(array.offsets.to_numpy().astype(np.int64)), array.flatten()


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def _part_rows(part: int, docs: pa.Array, lengths: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The index rows of some documents, given all their words end to end."""
    n = len(docs)
    coded = words.dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    rank = np.empty(n, np.int64)  # place of a document by falling length
    rank[np.argsort(-lengths, kind="stable")] = np.arange(n)
    doc = np.repeat(np.arange(n), lengths)
    position = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((position, rank[doc], codes, rank[doc] // BLOCK_DOCS))
    doc, codes, position = doc[order], codes[order], position[order]
    block = rank[doc] // BLOCK_DOCS
    pair = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.zeros(0, np.int64)
    tf = np.diff(np.append(pair, len(codes)))
    row = np.flatnonzero(np.concatenate([[True], (codes[pair][1:] != codes[pair][:-1]) | (block[pair][1:] != block[pair][:-1])])) if len(pair) else np.zeros(0, np.int64)
    by_rank = np.argsort(rank)
    starts = np.arange(0, n, BLOCK_DOCS)
    most = np.maximum.reduceat(tf, row) if len(row) else np.zeros(0, np.int64)
    none, ones = np.zeros(len(starts), np.int64), len(starts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(ones + len(row), part), pa.int64()),
            pa.array(np.concatenate([starts // BLOCK_DOCS, block[pair][row]]), pa.int32()),
            pa.concat_arrays([pa.array([ALL] * ones, pa.string()), terms.take(pa.array(codes[pair][row])).cast(pa.string())]),
            pa.ListArray.from_arrays(pa.array(np.concatenate([starts, np.full(len(row) + 1, n)]).astype(np.int32)), docs.take(pa.array(by_rank))),
            _lists(rank[doc[pair]] % BLOCK_DOCS, np.concatenate([none, row]), pa.int32()),
            _lists(tf, np.concatenate([none, row]), pa.int32()),
            _lists(position, np.concatenate([none, pair[row]]), pa.int32()),
            pa.array(np.concatenate([np.maximum.reduceat(lengths[by_rank], starts) if n else starts, most]), pa.int32()),
        ],
        names=["part", "block", "term", "docs", "places", "counts", "positions", "most"],
    )


def build_index(corpus: DataFrame, key: str, words: str) -> DataFrame:
    """``part``, ``block``, ``term``, ``docs``, ``places``, ``counts``, ``positions``, ``most`` of ``key`` and ``words`` (array of strings).

    A part holds about ``PART_WORDS`` words read by one task; positions follow each other document by document.
    """
    kind = corpus.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        docs, lengths, values, held = [], [], [], 0

        def part() -> pa.RecordBatch:
            return _part_rows((task << 32) + number, pa.concat_arrays(docs), np.concatenate(lengths), pa.concat_arrays(values))

        for batch in batches:
            n, flat = _flat(batch.column("words"))
            upto, at = np.concatenate([[0], np.cumsum(n)]), 0
            while at < len(n):  # a batch of long texts holds several parts
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + PART_WORDS - held, "right")) - 1)
                docs.append(batch.column("key").slice(at, end - at))
                lengths.append(n[at:end])
                values.append(flat.slice(int(upto[at]), int(upto[end] - upto[at])))
                held += int(upto[end] - upto[at])
                if end < len(n) or held >= PART_WORDS:
                    yield part()
                    docs, lengths, values, held, number = [], [], [], 0, number + 1
                at = end
        if docs:
            yield part()

    found = corpus.select(F.col(key).alias("key"), F.coalesce(words, F.array()).cast("array<string>").alias("words"))
    schema = f"part long, block int, term string, docs array<{kind}>, places array<int>, counts array<int>, positions array<int>, most int"
    return found.mapInArrow(work, schema)


class Block:
    """Postings of the asked terms in one block, by the number of the term in the slice."""

    def __init__(self, docs: np.ndarray, places: dict):
        self.docs, self.n, self.of = docs, len(docs), places

    def bound(self, terms: np.ndarray, weights: np.ndarray) -> float:
        return sum(w * self.of[t][3] for t, w in zip(terms, weights) if t in self.of)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.n)
        for t, w in zip(terms, weights):
            if t in self.of:
                at, counts, _, _ = self.of[t]
                total[at] += w * counts
        return total

    def holding(self, phrase: tuple[int, ...]) -> np.ndarray:
        """Documents that hold the terms of a phrase one after the other."""
        found = None
        for step, t in enumerate(phrase):
            if t not in self.of:
                return np.zeros(0, np.int64)
            at, counts, positions, _ = self.of[t]
            keys = (np.repeat(at, counts) << 32) + positions - step
            found = keys if found is None else np.intersect1d(found, keys, assume_unique=True)
        return np.unique(found >> 32) if found is not None else np.zeros(0, np.int64)


def _blocks(postings: pa.Table, number: dict) -> Iterator[tuple[Block, pa.Array]]:
    """Blocks by falling length of their longest document, each with its documents' keys."""
    postings = postings.sort_by([("part", "ascending"), ("block", "ascending"), ("term", "ascending")]).combine_chunks()
    part, block = (postings[c].to_numpy() for c in ("part", "block"))
    cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])]))
    stops = np.append(cuts[1:], len(part))
    for lo, hi in sorted(zip(cuts, stops), key=lambda c: -postings["most"][int(c[0])].as_py()):
        rows = postings.slice(lo, hi - lo)
        keys = rows["docs"].chunk(0)[0].values  # the block's own row comes first
        sizes, places = _flat(rows["places"].chunk(0))
        places = places.to_numpy().astype(np.int64)
        counts, positions = (_flat(rows[c].chunk(0)) for c in ("counts", "positions"))
        at, pos = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(positions[0])])
        tf, where, most = counts[1].to_numpy(), positions[1].to_numpy().astype(np.int64), rows["most"].to_numpy()
        of = {number[t]: (places[at[i] : at[i + 1]], tf[at[i] : at[i + 1]], where[pos[i] : pos[i + 1]], int(most[i])) for i, t in enumerate(rows["term"].to_pylist()) if t in number}
        yield Block(np.arange(len(keys)), of), keys


def best_of_part(postings: pa.Table, queries: pa.Table, page: int) -> tuple[list, pa.Array, list, int, int]:
    """The ``page`` best documents of a part for each query of a slice; also how many (block, query) pairs there were and were scored."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for terms in queries["terms"].to_pylist() for t in terms))}
    asked = [
        (np.array([number[t] for t in q["terms"]]), np.array(q["weights"]), [tuple(number.get(t, -1) for t in p) for p in q["phrases"]])
        for q in queries.select(["terms", "weights", "phrases"]).to_pylist()
    ]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in asked]
    keys, base, pairs, scored = [], 0, 0, 0
    for block, ids in _blocks(postings, number):
        held: dict[tuple[int, ...], np.ndarray] = {}
        for i, (terms, weights, phrases) in enumerate(asked):
            bound = block.bound(terms, weights)
            pairs += bound > 0
            at_least = best[i][0][-1] if len(best[i][0]) >= page else 0.0
            if bound <= 0 or bound * (2.0 if phrases else 1.0) * (1 + 1e-9) < at_least:
                continue
            scored += 1
            scores = block.scores(terms, weights)
            boosted = []
            for p in phrases:
                if p not in held:
                    held[p] = block.holding(p)
                boosted.append(held[p])
            if boosted:
                scores[np.unique(np.concatenate(boosted))] *= 2.0
            found = np.flatnonzero(scores > 0)
            values, places = np.concatenate([best[i][0], np.round(scores[found], 9)]), np.concatenate([best[i][1], base + found])
            if len(values) > page:  # equal scores at the edge all stay until ids decide
                edge = np.partition(values, len(values) - page)[len(values) - page]
                keep = values >= edge
                values, places = values[keep], places[keep]
            order = np.argsort(-values, kind="stable")
            best[i] = (values[order], places[order])
        keys.append(ids)
        base += len(ids)
    return best, pa.concat_arrays(keys) if keys else pa.array([], pa.int64()), asked, pairs, scored


def search(index: DataFrame, queries: DataFrame, page: int) -> DataFrame:
    """``query_id``, ``key``, ``score``, ``position`` (from 0) of the first ``page`` documents of each query, by score and then key.

    queries: ``query_id``, ``terms`` (distinct), ``phrases`` (arrays of terms). A term weighs ln((documents + 1) / documents
    that hold it), a document that holds a phrase scores double, and documents without any term are not found.
    """
    each = queries.select("query_id", F.explode("terms").alias("term"))
    asked = each.select("term").distinct()
    n_docs = index.filter(F.col("term") == ALL).agg(F.sum(F.size("docs")).alias("n_docs"))
    known = index.filter(F.col("term") != ALL).join(asked, "term", "left_semi").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    n = n_docs.first()[0] or 0
    weights = each.join(known, "term").withColumn("weight", F.log(F.lit(n + 1.0) / F.col("df")))
    packed = weights.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    packed = packed.join(queries.select("query_id", "phrases"), "query_id")
    slices = max(1, -(-queries.count() // SLICE_QUERIES))
    sliced = packed.select(
        F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("slice"), "query_id", F.col("t")["term"].alias("terms"), F.col("t")["weight"].alias("weights"), "phrases"
    )
    postings = index.filter(F.col("term") == ALL).unionByName(index.join(asked, "term", "left_semi").select(*index.columns))
    parts = index.select("part").distinct()
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>"))
    left, pairs = postings.withColumn("slice", every), parts.withColumn("slice", every)
    right = sliced.join(pairs, "slice").select("part", *sliced.columns)
    q_kind, k_kind = queries.schema["query_id"].dataType.simpleString(), index.schema["docs"].dataType.elementType.simpleString()

    def work(postings: pa.Table, queries: pa.Table) -> pa.Table:
        best, keys, _, _, _ = best_of_part(postings, queries, page) if len(postings) and len(queries) else ([], pa.array([], pa.int64()), [], 0, 0)
        sizes = [len(v) for v, _ in best]
        return pa.table(
            {
                "query_id": queries["query_id"].take(pa.array(np.repeat(np.arange(len(best)), sizes).astype(np.int64))) if best else queries["query_id"].slice(0, 0),
                "key": keys.take(pa.array(np.concatenate([p for _, p in best]).astype(np.int64))) if best else postings["docs"].combine_chunks().flatten().slice(0, 0),
                "score": pa.array(np.concatenate([v for v, _ in best]) if best else [], pa.float64()),
            }
        )

    found = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(work, f"query_id {q_kind}, key {k_kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    # The bare row number in the filter is what lets the limit run before the shuffle.
    top = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= page)
    return top.withColumn("position", F.col("_n") - 1).drop("_n")
