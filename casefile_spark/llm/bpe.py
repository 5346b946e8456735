"""Byte-level BPE by a segment tree over the ranks of adjacent pairs: the root holds the leftmost pair of lowest rank; a merge
changes three leaves, each in logarithmic time, and merging ends when the root holds no mergeable pair.

The vocabulary is a file of a public tokenizer, named by a path that every executor has; nothing is trained. Texts are cut into
pieces by the tokenizer's pattern, and merges never cross pieces, so a task keeps the ids of the pieces it has met (at most
``CACHE_PIECES``, then it begins anew). New short pieces of a batch are merged side by side: their trees are rows of one array,
and a round takes every row's root and updates every row's leaves. A piece beyond ``SIDE_BY_SIDE`` bytes is a tree of its own,
however long it is.

Nulls: a null text is empty, an empty text has no ids. Texts are taken whole. Other columns are ignored, rows of equal doc_id
stay rows of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

CACHE_PIECES = 400_000
SIDE_BY_SIDE = 65
NONE = 1 << 62

#: Fixed value: the pattern that byte-level BPE files of this kind cut texts with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes as they are, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTree:
    """The minimum over (rank, place) of adjacent pairs, as ``rank << bits | place``; node i has children 2i and 2i + 1."""

    def __init__(self, ranks: list[int]):
        self.bits = max(len(ranks) - 1, 0).bit_length()
        self.base = 1 << self.bits
        bits = self.bits
        tree = [NONE] * self.base + [NONE if r == NONE else r << bits | i for i, r in enumerate(ranks)]
        tree += [NONE] * (2 * self.base - len(tree))
        for i in range(self.base - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def update(self, place: int, rank: int) -> None:
        tree = self.tree
        i = self.base + place
        tree[i] = NONE if rank == NONE else rank << self.bits | place
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1


class PairTrees:
    """Many pair trees of one width, a row each, over rows of ids that are merged in place."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ranks):
        rows, self.width = ids.shape[0], ids.shape[1] - 1
        self.bits, self.ranks, self.lengths = self.width.bit_length() - 1, ranks, lengths
        self.ids = np.concatenate([ids, np.zeros((rows, 1), np.int64)], axis=1)
        self.after = np.tile(np.arange(1, self.width + 3), (rows, 1))
        self.before = self.after - 2
        self.tree = np.full((rows, 2 * self.width), NONE, np.int64)
        valid = np.arange(self.width) < (lengths - 1)[:, None]
        at, place = np.nonzero(valid)
        self.tree[at, self.width + place] = self._leaf(ids[at, place], ids[at, place + 1], place)
        for i in range(self.width - 1, 0, -1):
            self.tree[:, i] = np.minimum(self.tree[:, 2 * i], self.tree[:, 2 * i + 1])

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.ranks(left, right)
        return np.where(rank == NONE, NONE, rank << self.bits | place)

    def _update(self, rows: np.ndarray, place: np.ndarray, leaf: np.ndarray) -> None:
        node = self.width + place
        self.tree[rows, node] = leaf
        for _ in range(self.bits):
            node >>= 1
            self.tree[rows, node] = np.minimum(self.tree[rows, 2 * node], self.tree[rows, 2 * node + 1])

    def merge(self, merged: np.ndarray) -> None:
        """Until no root holds a pair; ``merged`` has the new id of each rank. Ids that went into others become -1."""
        while len(rows := np.flatnonzero(self.tree[:, 1] != NONE)):
            low = self.tree[rows, 1]
            i = low & (self.width - 1)
            j = self.after[rows, i]
            k = self.after[rows, j]
            self.ids[rows, i] = merged[low >> self.bits]
            self.ids[rows, j] = -1
            self.after[rows, i], self.before[rows, k] = k, i
            gone = j < self.lengths[rows] - 1  # the last id has no pair to its right
            self._update(rows[gone], j[gone], np.full(gone.sum(), NONE))
            more = k < self.lengths[rows]
            leaf = np.full(len(rows), NONE)
            leaf[more] = self._leaf(self.ids[rows[more], i[more]], self.ids[rows[more], k[more]], i[more])
            self._update(rows, i, leaf)
            h = self.before[rows, i]
            some = h >= 0
            rows, i, h = rows[some], i[some], h[some]
            self._update(rows, h, self._leaf(self.ids[rows, h], self.ids[rows, i], h))


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a byte-level BPE without normalizer")
        letters, vocab = byte_letters(), model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        self.shift = max(vocab.values()).bit_length()
        #: pair of ids to its rank and the id of the merged token.
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[left] << self.shift | vocab[right], (rank, vocab[left + right]))
        pairs = sorted(self.merges)
        self.pair_keys = np.array(pairs, np.int64)
        self.pair_ranks = np.array([self.merges[p][0] for p in pairs], np.int64)
        self.merged = np.zeros(len(model["merges"]) + 1, np.int64)
        self.merged[self.pair_ranks] = [self.merges[p][1] for p in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that take white space or whole words aren't supported")
        self.added = {content: np.uint32(i).tobytes() for content, i in added.items()}
        names = sorted(added, key=lambda x: (-len(x), x))
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.pieces = regex.compile(PATTERN).findall
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[x] for x in token)
        for content, i in added.items():
            self.token_bytes[i] = content.encode()
        self.known = dict(self.added)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge adjacent ids, lowest rank first and leftmost of equal ranks, until no pair can be merged."""
        n, merges, shift = len(ids), self.merges, self.shift
        if n < 2:
            return ids
        none = (NONE, 0)
        tree = PairTree([merges.get(ids[i] << shift | ids[i + 1], none)[0] for i in range(n - 1)])
        if tree.tree[1] == NONE:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        nodes, mask = tree.tree, tree.base - 1
        while (low := nodes[1]) != NONE:
            i = low & mask
            j = after[i]
            ids[i] = merges[ids[i] << shift | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.update(j, NONE)
            if k < n:
                before[k] = i
                tree.update(i, merges.get(ids[i] << shift | ids[k], none)[0])
            else:
                tree.update(i, NONE)
            h = before[i]
            if h >= 0:
                tree.update(h, merges.get(ids[h] << shift | ids[i], none)[0])
        return [x for x in ids if x >= 0]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_piece(self, piece: str) -> bytes:
        return np.array(self.merge(self.byte_ids[np.frombuffer(piece.encode(), np.uint8)].tolist()), dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, those of like length side by side."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        width = 1
        while width < SIDE_BY_SIDE:
            some = np.flatnonzero((sizes <= width + 1) & (sizes > (width // 2 + 1 if width > 1 else 0)))
            if len(some):
                n = sizes[some]
                inside = np.arange(width + 1) < n[:, None]
                at = np.where(inside, (ends[some] - n)[:, None] + np.arange(width + 1), 0)
                trees = PairTrees(np.where(inside, self.byte_ids[data[at]], -1), n, self.ranks_of)
                trees.merge(self.merged)
                kept = trees.ids[:, : width + 1] >= 0
                kept &= inside
                flat, stops = trees.ids[:, : width + 1][kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
                starts = np.concatenate([[0], stops[:-1]])
                self.known.update((pieces[p], flat[a:b]) for p, a, b in zip(some.tolist(), starts.tolist(), stops.tolist()))
            width *= 2

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(text) for text in texts]
        new = set(chain.from_iterable(cut)) - self.known.keys()
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = dict(self.added)
            new = set(chain.from_iterable(cut)) - self.known.keys()
        long = {p: self.encode_piece(p) for p in new if len(p) * 4 >= SIDE_BY_SIDE and len(p.encode()) >= SIDE_BY_SIDE}
        self.known.update(long)
        self.learn([*new - long.keys()] if long else [*new])
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        for piece in long:
            del self.known[piece]
        return out

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text; an added token is one."""
        find = self.pieces
        if self.special is None or self.special.search(text) is None:
            return find(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [*find(text[at : found.start()]), found[0]]
            at = found.end()
        return out + find(text[at:])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One reading of the file a worker."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``: little-endian unsigned 32-bit token ids of each whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in chunks(batches, "text"):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.large_binary() if sum(map(len, ids)) >> 31 else pa.binary())], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``encode``'s rows with ``text``, the text their ids stand for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in chunks(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(map(bpe.decode, batch.column("ids").to_pylist()), pa.string())], names=["key", "ids", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key).alias("key"), "ids").mapInArrow(work, f"key {kind}, ids binary, text string").withColumnRenamed("key", key)
