"""Exact dedup by Grace hashing: records are partitioned to spill files by hash, a bucket that is too large is partitioned
again by another hash, and each bucket goes through an open-addressing table that compares complete contents.

Every task first passes its own input through such a table, so that a content reaches its bucket once per task
(and per ``flush_bytes`` of text), however many copies there are. Copies travel on as pairs of row numbers, without text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, by_ids, partitions_for
from .words import chunks

FLUSH_BYTES = 32 << 20
BUCKET_BYTES = 64 << 20
MAX_LEVELS = 4
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_MANY = re.compile(rb"  +")


def one_space(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(_SPACES)
    return _MANY.sub(b" ", text) if b"  " in text else text


class ContentTable:
    """Open addressing with linear probing; equal means equal bytes, hashes only pick the slot."""

    def __init__(self):
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.slots = [-1] * 1024
        self.bytes = 0

    def place(self, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        h = xxhash.xxh3_64_intdigest(content)
        mask = len(self.slots) - 1
        i = h & mask
        while (n := self.slots[i]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return n, False
            i = (i + 1) & mask
        n = self.slots[i] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.bytes += len(content)
        if len(self.contents) * 5 > len(self.slots) * 3:
            self._grow()
        return n, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for n, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = n


def _order(doc_id: int | None, row: int) -> tuple:
    return (doc_id is None, doc_id or 0, row)


_LOCAL = "row long, doc_id long, rep long, n long, first_doc long, first_row long, digest string, content binary"


def _local_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    table, rows = ContentTable(), []

    def flush():
        first: dict[int, tuple] = {}
        count: dict[int, int] = {}
        for r, doc, n, _ in rows:
            count[n] = count.get(n, 0) + 1
            if n not in first or _order(doc, r) < first[n]:
                first[n] = _order(doc, r)
        reps: dict[int, int] = {}
        out = []
        for r, doc, n, new in rows:
            if new:
                reps[n] = r
                content, (none, low, low_row) = table.contents[n], first[n]
                out.append((r, doc, r, count[n], None if none else low, low_row, hashlib.sha256(content).hexdigest(), content))
            else:
                out.append((r, doc, reps[n], None, None, None, None, None))
        kinds = (pa.int64(),) * 6 + (pa.string(), pa.binary())
        names = [c.split()[0] for c in _LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in chunks(batches, "text"):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            n, new = table.place(one_space(text.as_py() or b""))
            rows.append((row, doc, n, new))
            row += 1
        if table.bytes >= FLUSH_BYTES or len(rows) >= 200_000:
            yield flush()
            table, rows = ContentTable(), []
    if rows:
        yield flush()


_GROUPS = "rep long, keep_id long, keep_row long, group_size long, text_sha256 string"


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spill file through one table; contents of all tasks meet here."""
    table, reps, members, size, first, digest = ContentTable(), [], [], [], [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("rep", "n", "first_doc", "first_row", "digest", "content")]
        for rep, n, doc, row, sha, content in zip(*cols):
            k, new = table.place(content)
            if new:
                size.append(0)
                first.append(_order(doc, row))
                digest.append(sha)
            reps.append(rep)
            members.append(k)
            size[k] += n
            first[k] = min(first[k], _order(doc, row))
    for lo in range(0, len(reps), 50_000):
        part = members[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reps[lo : lo + 50_000], pa.int64()),
                pa.array([None if first[k][0] else first[k][1] for k in part], pa.int64()),
                pa.array([first[k][2] for k in part], pa.int64()),
                pa.array([size[k] for k in part], pa.int64()),
                pa.array([digest[k] for k in part], pa.string()),
            ],
            names=[c.split()[0] for c in _GROUPS.split(", ")],
        )


def _spill_file(level: int, files: int):
    return F.pmod(F.xxhash64(F.col("digest"), F.lit(level)), F.lit(files)).cast("int")


def _files(contents: DataFrame, work: Workspace, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The spill file of each content: files over ``bucket_bytes`` are split by the next hash, level by level."""
    files = total = partitions_for(contents, contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0, bucket_bytes / 2)
    placed = contents.withColumn("file", _spill_file(0, files))
    for level in range(1, MAX_LEVELS):
        sizes = placed.groupBy("file", "digest").agg(F.max(F.octet_length("content")).alias("bytes")).groupBy("file").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("distinct"))
        large = work.keep(sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("distinct") > 1)).select("file", F.lit(True).alias("split")), f"large{level}")
        if large.isEmpty():
            break
        placed = placed.join(large, "file", "left").withColumn("file", F.when(F.col("split"), total + _spill_file(level, files)).otherwise(F.col("file"))).drop("split")
        total += files
    return placed, total


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space; null is the empty
    text. The row with the smallest ``doc_id`` stays, a null id only if its group has no other; of rows that repeat an
    id, one stays. No rows give no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    return _found(docs, Workspace(docs.sparkSession, "exact-dedup"), bucket_bytes)


def _found(docs: DataFrame, work: Workspace, bucket_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = work.keep(rows.mapInArrow(_local_copies, _LOCAL), "local")
    contents, files = _files(local.filter("content is not null").select("rep", "n", "first_doc", "first_row", "digest", "content"), work, bucket_bytes)
    groups = contents.repartitionById(files, F.col("file")).mapInArrow(_bucket_groups, _GROUPS)
    found = local.select("row", "doc_id", "rep").join(groups, "rep")
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def first_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows without id, and rows that share one, are told apart by their text."""
    work = Workspace(docs.sparkSession, "first-copies")
    found = work.keep(_found(docs, work, bucket_bytes), "found")
    work.drop("local")
    shared = work.keep(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("s")), "shared")
    gone = work.keep(found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")), "gone")
    if shared.isEmpty():
        return by_ids(docs, gone, "gone", kept=False)
    same = docs["doc_id"].cast("long").eqNullSafe(shared["s"])
    alone = by_ids(docs.join(shared, same, "left_anti"), gone, "gone", kept=False)
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    kept = found.filter("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("d")).distinct()
    both = docs.join(shared, same, "left_semi").withColumn("__digest", digest)
    both = both.join(kept, both["doc_id"].cast("long").eqNullSafe(kept["k"]) & (both["__digest"] == kept["d"]), "left_semi")
    return alone.unionByName(both.dropDuplicates(["doc_id", "__digest"]).drop("__digest"))
