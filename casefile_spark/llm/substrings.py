"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are dealt to groups by their leading words: one word, or as many more as it takes until a group fits the
memory of a task. Inside a group the sorted suffixes are walked as the nodes of their suffix tree, cut at ``window`` words; a
deep node, one at that depth, is a word sequence that repeats, and its leaves' smallest document keeps it. Longer repeats
are chains of such windows and come out as one span.

Only suffixes that can repeat become leaves. Every window has an anchor, its least run of ``ANCHOR`` words by hash, and equal
windows have equal anchors: a window whose anchor is in one document alone does not repeat. Whole copies of a document are
settled by a digest before. Both leave every repeated window of the rest in the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace
from .words import Words, chunks, find_words

WINDOW = 13
ANCHOR = 4
GROUP_SUFFIXES = 200_000
PREFIX_WORDS = (1, 2, 4, 8)
TURNS = 4  # groups are dealt out in turns, so that a part of the suffixes is on disk at a time
NO_ID = (1 << 63) - 1  # a null id, after all others


def _anchors(words: Words, codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and the anchor of each."""
    starts, runs = words.runs(codes, ANCHOR)
    at = words.runs(codes, window)[0]
    by_start = np.zeros(codes.size + 1, dtype=np.uint64)
    by_start[starts] = runs
    least = by_start[at]
    for j in range(1, window - ANCHOR + 1):
        np.minimum(least, by_start[at + j], out=least)
    return at, least


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        split = [t.as_py().split() if t.is_valid else [] for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in split], pa.binary()), pa.array([len(w) for w in split], pa.int64())], names=["doc", "digest", "n"]
        )


def _anchor_rows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = find_words(batch.column("text"))
            at, least = _anchors(words, words.codes(), window)
            if not at.size:
                continue
            row = words.row()[at]
            new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), batch.column("doc").take(pa.array(row[new]))], names=["anchor", "doc"])

    return work


def _suffix_rows(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per window sequence and document; the first of a sequence in a chunk carries its words and the chunk's span of ids."""
        for batch in chunks(batches, "text"):
            words = find_words(batch.column("text"))
            codes = words.codes()
            at, least = _anchors(words, codes, window)
            if not at.size:
                continue
            repeated = np.unique(batch.column("anchors").flatten().to_numpy()).view(np.uint64)
            keep = np.isin(least, repeated)
            at, code = at[keep], words.runs(codes, window)[1][keep]
            if not at.size:
                continue
            doc = batch.column("doc").to_numpy()[words.row()[at]]
            order = np.lexsort((doc, code))
            at, code, doc = at[order], code[order], doc[order]
            new_code = np.concatenate([[True], code[1:] != code[:-1]])
            new = new_code | np.concatenate([[True], doc[1:] != doc[:-1]])
            high = np.maximum.reduceat(doc, np.flatnonzero(new_code))
            texts = [t.as_py() for t in batch.column("text").cast(pa.large_binary())]
            flat = [w for t in texts if t for w in t.split()]
            at, code, doc, first = at[new], code[new], doc[new], new_code[new]
            suffix = [b" ".join(flat[i : i + window]) if f else None for i, f in zip(at.tolist(), first.tolist())]
            top = np.zeros(at.size, np.int64)
            top[first] = high
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.view(np.int64)), pa.array(doc), pa.array(suffix, pa.binary()).view(pa.string()), pa.array(top, mask=~first)], names=["code", "doc", "suffix", "high"]
            )

    return work


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def tree_nodes(suffixes: Iterator[tuple[str, int, int, int]], depth: int) -> Iterator[tuple[int, int, int]]:
    """(code, smallest document, largest document) of each node at ``depth`` or below whose leaves are in several documents.

    ``suffixes`` are (words, code, smallest, largest) in the order of their words. The stack holds the path from the root to
    the last suffix: its nodes' depths, and what their leaves have met so far.
    """
    path: list[list[int]] = [[0, 0, NO_ID, -NO_ID]]
    last, words = None, []

    def close(until: int) -> Iterator[tuple[int, int, int]]:
        while path[-1][0] > until:
            node = path.pop()
            if node[0] >= depth and node[2] < node[3]:
                yield node[1], node[2], node[3]
            if path[-1][0] < until:
                path.append([until, node[1], NO_ID, -NO_ID])
            path[-1][2], path[-1][3] = min(path[-1][2], node[2]), max(path[-1][3], node[3])

    for suffix, code, low, high in suffixes:
        if suffix != last:
            now = suffix.split(" ")
            yield from close(_common(words, now))
            path.append([len(now), code, low, high])
            last, words = suffix, now
        else:
            path[-1][2], path[-1][3] = min(path[-1][2], low), max(path[-1][3], high)
    yield from close(0)


def _trees(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("suffix", "code", "low", "high"))))
        out: list[tuple[int, int, int]] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], names=["code", "low"])

        for node in tree_nodes(rows, window):
            out.append(node)
            if len(out) >= 20_000:
                yield table()
                out = []
        if out:
            yield table()

    return work


def _grouped(leaves: DataFrame, work: Workspace) -> DataFrame:
    """``prefix`` of each leaf: its leading words, more of them as long as a group has too many leaves."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = min(GROUP_SUFFIXES, max(64, leaves.count() // (8 * parts)))
    leaves = leaves.withColumn("prefix", F.substring_index("suffix", " ", PREFIX_WORDS[0]))
    for n, more in zip(PREFIX_WORDS, PREFIX_WORDS[1:]):
        here = leaves.filter(F.col("prefix") == F.substring_index("suffix", " ", n)) if n > 1 else leaves
        large = work.keep(here.groupBy("prefix").count().filter(F.col("count") > limit).select("prefix", F.lit(True).alias("large")), f"prefixes{n}")
        leaves = leaves.join(large, "prefix", "left").withColumn("prefix", F.when(F.col("large"), F.substring_index("suffix", " ", more)).otherwise(F.col("prefix"))).drop("large")
    return leaves


def covered(runs: np.ndarray, gone: np.ndarray, window: int) -> np.ndarray:
    """Which words of a document lie in a window whose code is in ``gone``; ``runs`` are its windows' codes."""
    edge = np.zeros(runs.size + window, dtype=np.int64)
    hit = np.flatnonzero(np.isin(runs, gone))
    edge[hit] += 1
    edge[hit + window] -= 1
    return np.cumsum(edge)[: runs.size + window - 1] > 0


_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string, kept_text string"


def _without(window: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            copies, docs, codes = batch.column("copy").to_pylist(), batch.column("doc_id"), batch.column("codes")
            some = np.flatnonzero(np.array(codes.is_valid()))
            words = find_words(batch.column("text").take(pa.array(some)))
            at, runs = words.runs(words.codes(), window)
            cut, place = np.searchsorted(at, words.first), {int(i): k for k, i in enumerate(some)}
            texts = batch.column("text").cast(pa.large_binary())
            rows = []
            for i in range(batch.num_rows):
                split = texts[i].as_py().split() if texts[i].is_valid else []
                n = len(split)
                mask = np.zeros(n, bool)
                if copies[i]:
                    mask[:] = n >= window
                elif codes[i].is_valid:
                    mask = covered(runs[cut[place[i]] : cut[place[i] + 1]], np.array(codes[i].as_py(), np.int64).view(np.uint64), window)
                if mask.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                    kept = b" ".join([w for w, m in zip(split, mask.tolist()) if not m])
                else:
                    edges, kept = [], b" ".join(split)
                rows.append((n, int(mask.sum()), [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])], hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string(), pa.string())
            names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``spans`` of removed words, ``kept_sha256``, ``kept_text``.

    A word goes when it lies in ``window`` consecutive words that also start in a document with a smaller id; windows are
    judged on the input. Null texts have no words. A null id is larger than all others, and rows that share an id, or have
    none, are one document and don't remove each other's words. No rows give no rows; other columns are not read.
    """
    work = Workspace(docs.sparkSession, "substrings")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    digests = work.keep(rows.mapInArrow(_digests, "doc long, digest binary, n long"), "digests").filter(F.col("n") >= window)
    firsts = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    copies = digests.join(firsts, "digest").filter("doc > first").groupBy("doc").agg(F.count("*").alias("copies"))
    # a document is settled when all rows of its id are copies
    rows_of = digests.groupBy("doc").agg(F.count("*").alias("rows"))
    copies = work.keep(rows_of.join(copies, "doc").filter("rows = copies").select("doc", F.lit(True).alias("copy")), "copies")
    single = rows.join(copies.select("doc"), "doc", "left_anti").select("doc", "text")

    anchors = work.keep(single.mapInArrow(_anchor_rows(window), "anchor long, doc long"), "anchor-rows")
    repeated = work.keep(anchors.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor"), "repeated")
    work.drop()
    held = anchors.join(repeated, "anchor").groupBy("doc").agg(F.collect_set("anchor").alias("anchors"))
    held = work.keep(held, "anchors")
    work.drop("repeated", "anchor-rows")

    suffixes = single.join(held, "doc").select("doc", "text", "anchors").mapInArrow(_suffix_rows(window), "code long, doc long, suffix string, high long")
    suffixes = work.keep(suffixes, "suffixes")
    work.drop("anchors")
    leaves = _grouped(suffixes.filter("suffix is not null").select("suffix", "code", F.col("doc").alias("low"), "high"), work)
    # the group's number travels instead of its prefix; equal suffixes have equal prefixes
    leaves = leaves.select("suffix", "code", "low", "high", F.xxhash64("prefix").alias("group"))
    nodes = None
    for turn in range(TURNS):
        dealt = leaves.filter(F.pmod("group", F.lit(TURNS)) == turn).repartition("group").select("suffix", "code", "low", "high")
        part = work.keep(dealt.sortWithinPartitions("suffix").mapInArrow(_trees(window), "code long, low long"), f"nodes{turn}")
        nodes = part if nodes is None else nodes.unionByName(part)
        work.drop()
    gone = suffixes.select("code", "doc").join(nodes, "code").filter("doc > low").groupBy("doc").agg(F.collect_set("code").alias("codes"))
    gone = work.keep(gone, "gone")
    work.drop("suffixes", *(f"nodes{turn}" for turn in range(TURNS)))

    marked = rows.join(gone, "doc", "left").join(copies, "doc", "left")
    marked = marked.select(F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"), "text", "codes", F.coalesce("copy", F.lit(False)).alias("copy"))
    return marked.mapInArrow(_without(window, with_text), _RESULT)
