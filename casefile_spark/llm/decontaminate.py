"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every passage of every document.

The index is cut into shards of a bounded size; each is sent around and all passages are run against it. Impacts are divided
by the score an item asks for, so the threshold is 1 for all. As in block-max WAND, bounds come before scores: a passage
whose terms' largest impacts don't add up to 1 is done; for the others the largest impacts per block of items are added
up, and postings are scored in the blocks alone whose bound reaches 1. No item above its threshold is lost. What is retrieved
is verified against the words around the passage: the runs of the item's question and of its answer must be there, or
else enough of the whole item's words, each in a run of three, so that an edit costs the words it changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace
from .words import chunks, find_words

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
SCORE = 0.5
OVERLAP = 0.8
RUN = 5
NEIGHBOURS = 3
BLOCK_ITEMS = 16
SHARD_POSTINGS = 500_000
_ASCII = bytes(range(33, 127)).decode()
_PLAIN = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)
_TABLE = bytes.maketrans(_ASCII.encode(), _PLAIN.encode())
_END = (b".", b"?", b"!")


def plain(column: pa.Array) -> pa.Array:
    """A to Z in lower case and ASCII punctuation as spaces; null is empty."""
    return pa.array([t.as_py().translate(_TABLE) if t.is_valid else b"" for t in column.cast(pa.large_binary())], pa.large_binary()).view(pa.large_string())


def question_and_answer(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; an item of one sentence is a question alone."""
    ends = [i for i, w in enumerate(words[:-1]) if w.endswith(_END)]
    return (words[: ends[-1] + 1], words[ends[-1] + 1 :]) if ends else (words, [])


def _runs(words: list[bytes]) -> tuple[int, np.ndarray]:
    """Length and distinct codes of the runs that stand for a part of an item; short parts take shorter runs."""
    found = find_words(plain(pa.array([b" ".join(words)])))
    n = min(RUN, max(1, found.start.size // 3)) if found.start.size else 0
    return n, np.unique(found.runs(found.codes(), n)[1]) if n else np.zeros(0, np.uint64)


def _pairs(text: str) -> np.ndarray:
    """Codes of the runs of ``NEIGHBOURS`` words of an item, in order."""
    found = find_words(plain(pa.array([text])))
    return found.runs(found.codes(), min(NEIGHBOURS, found.start.size))[1]


def _matched(pairs: np.ndarray, around: np.ndarray, n: int) -> float:
    """The share of an item's ``n`` words that are in one of its ``pairs`` which is among those ``around``."""
    hit, held = np.isin(pairs, around), np.zeros(n, bool)
    for k in range(n - pairs.size + 1):
        held[k : k + pairs.size] |= hit
    return float(held.mean())


@dataclass
class Shard:
    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    items: list[tuple[int, int, tuple[int, np.ndarray], tuple[int, np.ndarray], np.ndarray]]

    def __post_init__(self):
        term = np.repeat(np.arange(self.terms.size), np.diff(self.first))
        self.top = np.maximum.reduceat(self.impact, self.first[:-1]) if self.terms.size else np.zeros(0)
        self.blocks = (len(self.items) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        key = term * self.blocks + self.item // BLOCK_ITEMS
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block_first = np.searchsorted(term[start], np.arange(self.terms.size + 1))
        self.block, self.block_top = (self.item // BLOCK_ITEMS)[start], np.maximum.reduceat(self.impact, start)

    def search(self, term: np.ndarray, passage: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all scores of 1 or more, for distinct (passage, term) pairs."""
        pair, block = _spread(self.block_first, term)
        bound = np.bincount(passage[pair] * self.blocks + self.block[block], self.block_top[block], passages * self.blocks)
        pair, posting = _spread(self.first, term)
        alive = bound[passage[pair] * self.blocks + self.item[posting] // BLOCK_ITEMS] >= 1 - 1e-9
        pair, posting = pair[alive], posting[alive]
        key, at = np.unique(passage[pair] * len(self.items) + self.item[posting], return_inverse=True)
        score = np.bincount(at, self.impact[posting], key.size)
        key, score = key[score >= 1], score[score >= 1]
        return key // len(self.items), key % len(self.items), score


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a list of lists, (position in ``rows``, element)."""
    size = first[rows + 1] - first[rows]
    pair = np.repeat(np.arange(rows.size), size)
    return pair, np.arange(pair.size) - np.repeat(np.cumsum(size) - size, size) + first[rows][pair]


def passages_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of all passages, as word positions, of documents that begin at ``first``."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - (PASSAGE - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(n.size), count)
    start = first[doc] + STRIDE * (np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + PASSAGE, first[doc + 1])


def _shards(items: DataFrame, work: Workspace) -> Iterator[Shard]:
    """The index, built in Spark and fetched a shard at a time."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(text, _ASCII, _PLAIN), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).distinct()
    rows = rows.withColumn("words", words).filter(F.size("words") > 0).withColumn("n", F.size("words"))
    rows = work.keep(rows.withColumn("key", F.xxhash64("item_id", "text")), "items")
    total = rows.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.sum("n").alias("words")).first()
    if not total["items"]:
        return
    tf = rows.select("key", "n", F.explode("words").alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total["items"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / total["mean"]))
    postings = tf.join(df, "term").select("key", "n", "term", impact.alias("impact"))
    asked = SCORE * F.sum("impact").over(Window.partitionBy("key")) * F.least(F.lit(1.0), F.lit(STRIDE) / F.col("n"))
    parts = int(total["words"] // SHARD_POSTINGS) + 1
    postings = work.keep(postings.withColumn("impact", F.col("impact") / asked).withColumn("shard", F.pmod("key", F.lit(parts))), "postings")
    for shard in range(parts):
        held = rows.filter(F.pmod("key", F.lit(parts)) == shard).orderBy("item_id", "key").toPandas()
        if held.empty:
            continue
        number = {k: i for i, k in enumerate(held["key"].tolist())}
        found = postings.filter(F.col("shard") == shard).select("term", "key", "impact").toPandas()
        terms, at = np.unique(found["term"].to_numpy(), return_inverse=True)
        codes = find_words(pa.array(terms.tolist(), pa.large_string())).codes()
        rank = np.argsort(codes)
        place = np.empty_like(rank)
        place[rank] = np.arange(rank.size)
        term, item = place[at], np.array([number[k] for k in found["key"].tolist()])
        order = np.lexsort((item, term))
        parts_of = [(None if i is None or i != i else int(i), n, *(_runs(part) for part in question_and_answer(t.encode().split())), _pairs(t)) for i, n, t in zip(held["item_id"], held["n"].tolist(), held["text"])]
        yield Shard(codes[rank], np.searchsorted(term[order], np.arange(rank.size + 1)), item[order], found["impact"].to_numpy()[order], parts_of)


def _share(runs: np.ndarray, part: tuple[int, np.ndarray]) -> float:
    return float(np.isin(part[1], runs).mean()) if part[1].size else 1.0


_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def held_items(texts: pa.Array, shard: Shard) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(score, question overlap, answer overlap) by (row, item) for the items that stand in these texts."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    words = find_words(plain(texts))
    if not words.start.size or not shard.terms.size:
        return best
    codes = words.codes()
    term = np.minimum(np.searchsorted(shard.terms, codes), shard.terms.size - 1)
    known = shard.terms[term] == codes
    start, stop = passages_of(words.first)
    sums = np.concatenate([[0.0], np.cumsum(np.where(known, shard.top[term], 0.0))])
    live = np.flatnonzero(sums[stop] - sums[start] >= 1 - 1e-6)
    if not live.size:
        return best
    size = stop[live] - start[live]
    passage = np.repeat(np.arange(live.size), size)
    at = np.arange(passage.size) - np.repeat(np.cumsum(size) - size, size) + start[live][passage]
    pair = np.unique(passage[known[at]] * shard.terms.size + term[at][known[at]])
    term_of, passage_of = pair % shard.terms.size, pair // shard.terms.size
    # distinct terms give a tighter bound than the running sums
    bound = np.bincount(passage_of, shard.top[term_of], live.size)[passage_of] >= 1 - 1e-6
    if not bound.any():
        return best
    hit, item, score = shard.search(term_of[bound], passage_of[bound], live.size)
    for p, i, s in zip(live[hit].tolist(), item.tolist(), score.tolist()):
        row = int(np.searchsorted(words.first, start[p], side="right")) - 1
        _, n, question, answer, pairs = shard.items[i]
        lo, hi = max(words.first[row], start[p] - n), min(words.first[row + 1], stop[p] + n)
        shares = []
        for part in (question, answer):
            k = part[0]
            begin = np.arange(lo, hi - k + 1) if k and hi - lo >= k else np.zeros(0, np.int64)
            shares.append(_share(words.spans(codes, begin, begin + k), part) if k else 1.0)
        k = n - pairs.size + 1
        begin = np.arange(lo, max(lo, hi - k + 1))
        if min(shares) >= OVERLAP or _matched(pairs, words.spans(codes, begin, begin + k), n) >= OVERLAP:
            best[row, i] = max(best.get((row, i), (0.0, 0.0, 0.0)), (s * SCORE, *shares))
    return best


def _query(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = sent.value
        for batch in chunks(batches, "text"):
            best = held_items(batch.column("text"), shard)
            if best:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], shard.items[i][0], *v) for (r, i), v in best.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return work


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap`` for each document that holds an item.

    ``score`` is the best passage's BM25 score as a share of the item's own. An item is held when a passage reaches half of
    that (less for items longer than a passage) and at least 0.8 of the runs of five words of its question and of its answer
    stand around the passage, or 0.8 of all its words, each in a run of three of them. Case and ASCII punctuation are ignored. Null and blank texts hold nothing and blank items are in no document;
    items that repeat an id and text count once. Null ids are returned as null. Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "decontaminate")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shard in _shards(items, work):
        part = rows.mapInArrow(_query(docs.sparkSession.sparkContext.broadcast(shard)), _FOUND)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], _FOUND) if found is None else found


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, in a pass per shard without a shuffle."""

    def without(sent):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                mask = np.ones(batch.num_rows, bool)
                mask[[row for row, _ in held_items(batch.column("text"), sent.value)]] = False
                yield batch.filter(pa.array(mask))

        return work

    for shard in _shards(items, Workspace(docs.sparkSession, "decontaminate")):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(shard)), docs.schema)
    return docs
