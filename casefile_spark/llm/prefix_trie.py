"""Prefix trie of conversations by time-forward processing: nodes in reverse level order pass subtree totals to their parents
through spilling priority queues, within shards first and then across the shard roots.

* A turn becomes a 128-bit digest of role and text. The node of a prefix has as its digest two 64-bit sums over the prefix, of
  each turn's digest mixed with its position, so that equal prefixes meet under one digest.
* Conversations are cut into bands of ``BAND`` levels, one row per conversation and band: the path of node digests in the band.
  Rows are dealt to shards by ranges of (path, conv_id), so a shard is a run of the trie in preorder, one path with a third
  of all conversations is split among shards, and only nodes on a shard's first and last path (its spine) have members elsewhere.
* In a shard, nodes are sorted by falling depth (Spark's external sort) and swept. A whole node sends its totals to its parent;
  a spine node's partial totals go on to the second sweep, across shards: at most 2 x ``BAND`` rows a shard.
* Conversations beyond ``BAND`` turns hang whole bands below a node of the band above. Totals add up, so the bands' own totals
  are swept first as a tree of bands (a row per ``BAND`` turns of a distinct long conversation, streamed through one task).

Nulls: a null role or text is empty, a null turn comes first, a row without conv_id belongs to no conversation. Turns of equal
number are ordered by role, the text's first ``TIE_CHARS`` code points and then by digest; equal rows are all kept. Texts are read whole. Columns beyond conv_id, turn,
role and text are ignored. No conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, partitions_for
from .words import mixed

BAND = 128
QUEUE_ROWS = 200_000
BLOCK_IDS = 4096
BATCH = 4096
SHARD_BYTES = 64 << 20
SMALL_ROWS = 200_000
TIE_CHARS = 32
ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)

# -- turns of a conversation, numbered and packed ---------------------------------------------------------------------

_CHUNKS = "conv_id long, pid int, start long, edge boolean, tail boolean, items array<struct<v: binary, chars: int>>"
_ITEMS = pa.list_(pa.struct([("v", pa.binary()), ("chars", pa.int32())]))


def turn_table(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``begins``, ``v`` (digest of role and text), ``chars`` (code points of the text) and a number that splits equal rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("begins"), digest.alias("v"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as chunks of at most ``BAND`` turns of one conversation; ``start`` counts from the task's first turn of it."""
    pid = TaskContext.get().partitionId()
    out, open_conv, items, start, first = [], None, [], 0, True

    def close(tail: bool, edge: bool) -> None:
        out.append((open_conv, pid, start, edge, tail, items))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), _ITEMS)
        names = ("conv_id", "pid", "start", "edge", "tail", "items")
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

    for batch in batches:
        for conv, v, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "v", "chars"))):
            if conv != open_conv:
                if open_conv is not None:
                    close(True, first)
                    first = False
                open_conv, items, start = conv, [], 0
            elif len(items) == BAND:
                close(False, first)
                items, start = [], start + BAND
            items.append({"v": v, "chars": chars})
            if len(out) >= BATCH:
                yield flush()
    if open_conv is not None:
        close(True, True)
    if out:
        yield flush()


def packed_turns(turns: DataFrame, work: Workspace, tasks: int) -> DataFrame:
    """``conv_id``, ``at`` (number of the first turn, from 0), ``final`` (no turn follows) and ``items`` of each chunk.

    Turns are sorted by ranges, so a conversation with a third of all turns is many tasks. Only the first and the last
    conversation of a task can have turns elsewhere: two rows a task say how many.
    """
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("begins"), F.col("v"), F.col("row")]
    chunks = work.keep(turns.repartitionByRange(tasks, *key).sortWithinPartitions(*key).mapInArrow(_packed, _CHUNKS), "chunks")
    edges = chunks.filter("edge").groupBy("conv_id", "pid").agg(F.max(F.col("start") + F.size("items")).alias("n"))
    along = Window.partitionBy("conv_id").orderBy("pid")
    edges = edges.select(
        F.col("conv_id").alias("_conv"), F.col("pid").alias("_pid"), F.lead("pid").over(along).isNull().alias("_last"),
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    joined = chunks.join(F.broadcast(edges), (F.col("conv_id") == F.col("_conv")) & (F.col("pid") == F.col("_pid")), "left")
    return joined.select(
        "conv_id", (F.col("start") + F.coalesce("_before", F.lit(0))).alias("at"), (F.col("tail") & F.coalesce("_last", F.lit(True))).alias("final"), "items"
    )


def banded(chunks: DataFrame, shared: tuple[int, int] | None) -> DataFrame:
    """``conv_id``, ``band``, ``ends``, ``items`` per conversation and band; band b has the turns of depth b * BAND and on.

    With ``shared = (group, heads)`` conversation c first takes the first h turns of conversation c - c % group, then its own
    after its first h, where h = crc32(c) % heads.
    """
    q, items, keys = F.col("at"), F.col("items"), ["conv_id"]
    if shared:
        group, heads = shared
        base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
        head = chunks.filter((F.col("conv_id") % group == 0) & (F.col("at") < heads)).groupBy(F.col("conv_id").alias("base"))
        head = head.agg(F.slice(F.flatten(F.array_sort(F.collect_list(F.struct("at", "items")))["items"]), 1, heads).alias("head"))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
        chunks = chunks.select("*", base, h).join(head, "base", "left")
        lent = F.slice(F.coalesce("head", F.array().cast(items_ddl())), F.lit(1), F.col("h").cast("int"))
        own = F.greatest(F.col("at"), F.col("h"))
        rest = F.when(own - F.col("at") >= F.size("items"), F.array().cast(items_ddl())).otherwise(
            F.slice(items, (own - F.col("at") + 1).cast("int"), F.size("items"))
        )
        q = F.when(F.col("at") == 0, 0).otherwise(own - F.col("h") + F.size(lent))
        items, keys = F.when(F.col("at") == 0, F.concat(lent, rest)).otherwise(rest), ["base", "conv_id"]
    depth = F.col("q") + 1  # of the piece's first turn
    rows = chunks.select(*keys, "final", q.alias("q"), items.alias("items")).filter(F.col("final") | (F.col("q") == 0) | (F.size("items") > 0))
    last = F.col("q") + F.size("items")
    low = F.when(F.col("q") == 0, 0).otherwise(F.least(depth, last)) / F.lit(BAND)
    rows = rows.select("*", F.explode_outer(F.sequence(F.floor(low), F.floor(last / BAND))).alias("band"))
    start = F.greatest(F.col("band") * BAND - depth, F.lit(0))
    stop = F.least(F.col("band") * BAND + BAND - depth, F.size("items"))
    cut = F.when(stop > start, F.slice("items", (start + 1).cast("int"), (stop - start).cast("int"))).otherwise(F.array().cast(items_ddl()))
    rows = rows.select(*keys, "band", (F.col("final") & (F.col("band") == F.floor(last / BAND))).alias("ends"), F.struct((F.col("q") + start).alias("q"), cut.alias("items")).alias("piece"))
    return rows.groupBy(*keys, "band").agg(F.max("ends").alias("ends"), F.flatten(F.array_sort(F.collect_list("piece"))["items"]).alias("items"))


def items_ddl() -> str:
    return "array<struct<v: binary, chars: int>>"


# -- node digests along each band -------------------------------------------------------------------------------------

_SUMS = "".join(f", {name}{i} long" for name in ("all", "one") for i in range(4))
_PATHS = "conv_id long, band long, ends boolean, path binary, chars binary" + _SUMS


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """128-bit sums as four 32-bit parts, which Spark can add without overflow."""
    return [part.astype(np.int64) for v in (values[:, 0], values[:, 1]) for part in (v & _LOW, v >> np.uint64(32))]


def _whole(limbs: list[np.ndarray]) -> np.ndarray:
    limbs = [v.astype(np.uint64) for v in limbs]
    with np.errstate(over="ignore"):
        return np.stack([limbs[0] + (limbs[1] << np.uint64(32)), limbs[2] + (limbs[3] << np.uint64(32))], axis=1)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums along each band, from 0 at its beginning, and the sums of the whole band and of its first turn."""
    for batch in batches:
        lists, band = batch.column("items"), batch.column("band").to_numpy()
        ends = lists.offsets.to_numpy().astype(np.int64)
        first, n = ends[0], np.diff(ends)
        flat = lists.flatten()
        v = np.frombuffer(b"".join(flat.field("v").to_pylist()), dtype=np.uint64).reshape(-1, 2)
        depth = np.repeat(np.maximum(band * BAND, 1), n) + np.arange(len(v)) - np.repeat(ends[:-1] - first, n)
        with np.errstate(over="ignore"):
            terms = mixed(v ^ mixed(depth.astype(np.uint64)[:, None] * _SALT))
            sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(terms, axis=0, dtype=np.uint64)])
            lo, hi = ends[:-1] - first, ends[1:] - first
            total, one = sums[hi] - sums[lo], np.where((n > 0)[:, None], sums[np.minimum(lo + 1, len(v))] - sums[lo], np.uint64(0))
            along = sums[1:] - np.repeat(sums[lo], n, axis=0)
        raw, chars = along.tobytes(), flat.field("chars").to_numpy().astype(np.int32).tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), batch.column("band"), batch.column("ends"),
                pa.array([raw[16 * a : 16 * b] for a, b in zip(lo, hi)], pa.binary()),
                pa.array([chars[4 * a : 4 * b] for a, b in zip(lo, hi)], pa.binary()),
                *[pa.array(x) for x in _limbs(total) + _limbs(one)],
            ],
            names=["conv_id", "band", "ends", "path", "chars", *[f"{name}{i}" for name in ("all", "one") for i in range(4)]],
        )


_SEGMENTS = "conv_id long, band long, ends boolean, path binary, chars binary, above binary, up binary"


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First bands below the root."""
    for batch in batches:
        n = batch.num_rows
        path = pa.array([ROOT + p for p in batch.column("path").to_pylist()], pa.binary())
        chars = pa.array([bytes(4) + c for c in batch.column("chars").to_pylist()], pa.binary())
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "band", "ends")), path, chars, none, none], names=["conv_id", "band", "ends", "path", "chars", "above", "up"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later bands, with the sums of all bands before; ``above`` is the node above the band, ``up`` the top of the band before."""
    for batch in batches:
        before, earlier, one = (_whole([batch.column(f"{k}{i}").to_numpy() for i in range(4)]) for k in ("before", "earlier", "first"))
        path = []
        with np.errstate(over="ignore"):
            for p, b in zip(batch.column("path").to_pylist(), before):
                path.append((np.frombuffer(p, np.uint64).reshape(-1, 2) + b).tobytes())
            tops = earlier + one
        tops[batch.column("band").to_numpy() == 1] = 0
        pack = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "band", "ends")), pa.array(path, pa.binary()), batch.column("chars"), pack(before), pack(tops)],
            names=["conv_id", "band", "ends", "path", "chars", "above", "up"],
        )


def segments(bands: DataFrame, work: Workspace) -> tuple[DataFrame, bool]:
    """The rows of the trie: node digests (``path``) and code points (``chars``) of each conversation and band; whether any is long."""
    paths = work.keep(bands.select("conv_id", "band", "ends", "items").mapInArrow(_digests, _PATHS), "paths")
    first = paths.filter("band = 0").mapInArrow(_rooted, _SEGMENTS)
    if paths.filter("band > 0").isEmpty():
        return work.keep(first, "segments"), False
    along = Window.partitionBy("conv_id").orderBy("band")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = paths.filter("band > 0 OR NOT ends").select(
        F.col("conv_id").alias("_conv"), F.col("band").alias("_band"),
        *[F.sum(f"all{i}").over(before).alias(f"before{i}") for i in range(4)],
        *[F.coalesce(F.sum(f"all{i}").over(along.rowsBetween(Window.unboundedPreceding, -2)), F.lit(0)).alias(f"earlier{i}") for i in range(4)],
        *[F.lag(f"one{i}").over(along).alias(f"first{i}") for i in range(4)],
    ).filter("_band > 0")
    later = paths.filter("band > 0").join(sums, (F.col("conv_id") == F.col("_conv")) & (F.col("band") == F.col("_band")))
    later = later.select("conv_id", "band", "ends", "path", "chars", *[f"{k}{i}" for k in ("before", "earlier", "first") for i in range(4)])
    return work.keep(first.unionByName(later.mapInArrow(_carried, _SEGMENTS)), "segments"), True


# -- nodes of a shard -------------------------------------------------------------------------------------------------

#: kind: a node with all members here (WHOLE), one whose parent is completed elsewhere (HANGING), partial totals (SPINE), ids of ended members (IDS).
WHOLE, HANGING, SPINE, IDS = 0, 1, 2, 3
_NODES = pa.schema(
    [
        ("kind", pa.int32()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("n", pa.int64()), ("low", pa.int64()),
        ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("chars", pa.int64()), ("goes_on", pa.bool_()),
        ("ends_sha256", pa.string()), ("parent_conv_id", pa.int64()), ("shard", pa.int32()), ("seq", pa.int64()), ("ids", pa.binary()),
    ]
)
_NODES_DDL = (
    "kind int, depth long, node binary, parent binary, n long, low long, children long, leaves long, saved long, chars long, goes_on boolean, "
    "ends_sha256 string, parent_conv_id long, shard int, seq long, ids binary"
)


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


class _Open:
    """A node on the current path."""

    __slots__ = ("digest", "parent", "depth", "chars", "spine", "n", "low", "goes_on", "hung", "sha256")

    def __init__(self, digest: bytes, parent: bytes | None, depth: int, chars: int, spine: bool):
        self.digest, self.parent, self.depth, self.chars, self.spine = digest, parent, depth, chars, spine
        self.n, self.low, self.goes_on, self.hung, self.sha256 = 0, None, False, (0, 0, 0), EMPTY

    def row(self, shard: int) -> tuple:
        kind = SPINE if self.spine else WHOLE
        return (kind, self.depth, self.digest, self.parent, self.n, self.low, *self.hung, self.chars, self.goes_on, self.sha256, None, shard, 0, None)


def _shared(path: bytes, other: bytes | None) -> int:
    """Digests that two paths have in common from the top."""
    if other is None:
        return 0
    a, b = (np.frombuffer(p, np.uint64).reshape(-1, 2) for p in (path, other))
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]).all(axis=1)
    return n if same.all() else int(same.argmin())


_FED = ("conv_id", "band", "ends", "path", "chars", "above", "children", "leaves", "saved")


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the shard once, with what its own rows say. Paths come sorted, so a node is ready when a path leaves it.

    Ids of members that end at a node become its hash here, or go on in blocks when other shards may have more of them
    (the first and the last path) or when they are many.
    """
    shard = TaskContext.get().partitionId()

    def block(top: _Open, ids: list[bytes], seq: int) -> tuple:
        top.sha256 = None
        return (IDS, 1 << 62, top.digest, None, 0, None, 0, 0, 0, 0, False, None, None, shard, seq, b",".join(ids))

    def rows() -> Iterator[tuple]:
        stack: list[_Open] = []
        ids: list[bytes] = []
        now, first, seq = None, True, 0
        for batch in batches:
            for conv, band, ends, path, chars, above, *hung in zip(*(batch.column(k).to_pylist() for k in _FED)):
                if path != now:
                    if now is not None:
                        if ids and (first or seq):
                            yield block(stack[-1], ids, seq)
                        elif ids:
                            stack[-1].sha256 = hashlib.sha256(b",".join(ids)).hexdigest()
                        first, seq = False, 0
                        ids = []
                    keep = _shared(path, now)
                    while len(stack) > keep:
                        yield stack.pop().row(shard)
                    sizes = np.frombuffer(chars, np.int32)
                    for i in range(keep, len(path) // 16):
                        parent = stack[-1].digest if stack else above
                        stack.append(_Open(path[16 * i : 16 * i + 16], parent, band * BAND + i, int(sizes[i]), now is None))
                    now = path
                top = stack[-1]
                top.n += 1
                top.low = conv if top.low is None else min(top.low, conv)
                if not ends:
                    top.goes_on, top.hung = True, tuple(a + (x or 0) for a, x in zip(top.hung, hung))
                    continue
                ids.append(b"%d" % conv)
                if len(ids) >= BLOCK_IDS:
                    yield block(top, ids, seq)
                    ids, seq = [], seq + 1
        if stack and ids:
            yield block(stack[-1], ids, seq)
        while stack:
            stack[-1].spine = True
            yield stack.pop().row(shard)

    return _batched(rows(), _NODES)


# -- time-forward processing ------------------------------------------------------------------------------------------


class SpillingQueue:
    """A priority queue of messages to keys that are asked for in rising order.

    Beyond ``limit`` messages, those in memory are sorted and written to a scratch file of the task, which is read again
    in order; ``combine`` merges messages to one key while they are in memory.
    """

    def __init__(self, combine=None, limit: int | None = None):
        self.combine, self.limit = combine, limit or QUEUE_ROWS
        self.heap: list = []
        self.held: dict = {}
        self.runs: list = []
        self.number = 0

    def push(self, key, value) -> None:
        if self.combine and key in self.held:
            self.held[key] = self.combine(self.held[key], value)
            return
        self.number += 1
        if self.combine:
            self.held[key] = value
            heapq.heappush(self.heap, (key, self.number, None))
        else:
            heapq.heappush(self.heap, (key, self.number, value))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for key, number, value in sorted(self.heap, key=lambda x: x[:2]):
            pickle.dump((key, number, self.held[key] if self.combine else value), file)
        self.heap, self.held = [], {}
        file.seek(0)
        self.runs.append([file, self._next(file)])

    @staticmethod
    def _next(file):
        try:
            return pickle.load(file)
        except EOFError:
            file.close()
            return None

    def take(self, key=None) -> Iterator:
        """All messages to ``key``; without one, all that are left. Messages to smaller keys found no receiver and are dropped."""
        while self.heap and (key is None or self.heap[0][0] <= key):
            at, _, value = heapq.heappop(self.heap)
            value = self.held.pop(at) if self.combine else value
            if key is None or at == key:
                yield value
        for run in self.runs:
            while run[1] is not None and (key is None or run[1][0] <= key):
                if key is None or run[1][0] == key:
                    yield run[1][2]
                run[1] = self._next(run[0])
        self.runs = [run for run in self.runs if run[1] is not None]


def _low(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _add(a: tuple, b: tuple) -> tuple:
    """Totals ``n``, ``low``, ``children``, ``leaves``, ``saved`` of two parts."""
    return (a[0] + b[0], _low(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in their order; partial rows of one node follow each other and become one."""
    held = None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in _NODES.names)):
            if held is not None and row[0] != IDS and held[1:3] == row[1:3]:
                ends = held[11] if held[11] != EMPTY else row[11]
                held = (*held[:4], *_add(held[4:9], row[4:9]), held[9], held[10] or row[10], ends, *row[12:])
                continue
            if held is not None:
                yield held
            held = row
    if held is not None:
        yield held


def _sweep(across: bool, pieces: bool = True):
    """Nodes by falling depth: each takes the messages of its children and sends its totals to its parent.

    A child's row waits in a second queue until its parent knows its smallest member. Within a shard, spine nodes send
    nothing: their partial totals are rows for the sweep across shards. With ``pieces`` no message crosses bands.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            totals, waiting = SpillingQueue(_add), SpillingQueue()
            for row in _merged(batches):
                kind, depth, node, parent = row[:4]
                if kind == IDS:
                    yield row
                    continue
                own = row[4:9]
                for message in totals.take((-depth, node)):
                    own = _add(own, message)
                n, low, children, leaves, saved = own
                spine = kind == SPINE and not across
                for child in waiting.take((-depth, node)):
                    yield (HANGING, *child[1:]) if spine else (WHOLE, *child[1:12], low, *child[13:])
                if spine:
                    yield (*row[:4], *own, *row[9:])
                    continue
                if not children and not row[10]:
                    leaves = 1
                saved += max(n - 1, 0) * row[9]
                whole = (WHOLE, *row[1:4], n, low, children, leaves, saved, *row[9:])
                if parent is None:
                    yield whole
                elif pieces and depth % BAND == 0:
                    yield (HANGING, *whole[1:])
                else:
                    up = (-(depth - 1), parent)
                    totals.push(up, (n, low, 1, leaves, saved))
                    waiting.push(up, whole)
            for child in waiting.take():
                yield (HANGING, *child[1:])

        return _batched(rows(), _NODES)

    return work


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node``, ``ids_sha256`` from blocks of ids in order; only the hash of the node at hand is held."""

    def rows() -> Iterator[tuple]:
        now, state = None, None
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if node != now:
                    if now is not None:
                        yield now, state.hexdigest()
                    now, state = node, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if now is not None:
            yield now, state.hexdigest()

    return _batched(rows(), pa.schema([("node", pa.binary()), ("ids_sha256", pa.string())]))


def _swept(rows: DataFrame, work: Workspace, tasks: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all shards, and those of spine nodes after the sweep across shards."""
    key = ("path", "conv_id")
    nodes = rows.repartitionByRange(tasks, *key).sortWithinPartitions(*key).mapInArrow(_shard_nodes, _NODES_DDL)
    order = (F.desc("depth"), F.col("node"), F.col("seq"))
    shards = work.keep(nodes.sortWithinPartitions(*order).mapInArrow(_sweep(False), _NODES_DDL), f"shards-{name}")
    hashes = shards.filter(F.col("kind") == IDS).select("node", "shard", "seq", "ids").repartition("node").sortWithinPartitions("node", "shard", "seq")
    hashes = work.keep(hashes.mapInArrow(_hashed_ids, "node binary, ids_sha256 string"), f"hashes-{name}")

    def ended(df: DataFrame) -> DataFrame:
        known, open_ = df.filter("ends_sha256 IS NOT NULL"), df.filter("ends_sha256 IS NULL").join(hashes, "node", "left")
        return known.unionByName(open_.withColumn("ends_sha256", F.col("ids_sha256")).select(*df.columns))

    partial = ended(shards.filter(F.col("kind") == SPINE)).repartition(1).sortWithinPartitions(*order)
    spine = work.keep(partial.mapInArrow(_sweep(True), _NODES_DDL), f"spine-{name}")
    return ended(shards.filter(F.col("kind").isin(WHOLE, HANGING))), spine


def _hung(segs: DataFrame, work: Workspace, tasks: int) -> DataFrame:
    """What hangs below the last node of a band: ``end``, ``children``, ``leaves``, ``saved`` from the bands that follow it,
    to be counted with one row, that of conversation ``first``."""
    zero = F.lit(0).cast("long")
    later = segs.filter("band > 0")
    whole, spine = _swept(later.withColumns({"children": zero, "leaves": zero, "saved": zero}), work, tasks, "later")
    tops = whole.unionByName(spine).filter(F.col("depth") % BAND == 0).select("node", "leaves", "saved")
    links = later.select(F.substring("path", 1, 16).alias("node"), "above", "up", "band").distinct()
    tree = tops.join(links, "node").select(
        F.lit(WHOLE).alias("kind"), F.col("band").alias("depth"), "node", F.col("up").alias("parent"), zero.alias("n"), F.lit(None).cast("long").alias("low"),
        zero.alias("children"), "leaves", "saved", zero.alias("chars"), F.lit(True).alias("goes_on"), F.lit(EMPTY).alias("ends_sha256"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).alias("shard"), zero.alias("seq"), F.lit(None).cast("binary").alias("ids"),
    )
    summed = tree.repartition(1).sortWithinPartitions(F.desc("depth"), "node").mapInArrow(_sweep(True, pieces=False), _NODES_DDL)
    summed = summed.select("node", "leaves", "saved").join(links.select("node", "above"), "node")
    summed = summed.groupBy("above").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    first = later.groupBy("above").agg(F.min("conv_id").alias("first"))
    return work.keep(summed.join(first, "above").withColumnRenamed("above", "end"), "hung")


def prefix_trie(conversations: DataFrame, shared: tuple[int, int] | None = None) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (code points that members after the first repeat, over the subtree), ``ends_sha256`` (of the ids of
    conversations that end there) and ``node`` (digest of the prefix, hex).
    """
    spark = conversations.sparkSession
    work = Workspace(spark, "trie")
    turns = work.keep(turn_table(conversations), "turns")
    tasks = partitions_for(turns, turns.count() * 24.0, SHARD_BYTES)
    segs, long = segments(banded(packed_turns(turns, work, tasks), shared), work)
    work.drop("turns", "chunks", "paths")
    none = F.lit(None).cast("long")
    empty = {"children": none, "leaves": none, "saved": none}
    if long:
        hung = _hung(segs, work, tasks)
        open_ = segs.filter("NOT ends").join(hung, (F.expr("substring(path, -16)") == F.col("end")) & (F.col("conv_id") == F.col("first")), "left").drop("end", "first")
        rows = segs.filter("ends").withColumns(empty).unionByName(open_)
        work.drop("shards-later", "spine-later", "hashes-later")
    else:
        rows = segs.withColumns(empty)
    whole, spine = _swept(rows.select(*_FED), work, tasks, "all")
    parents = work.keep(
        spine.unionByName(whole.filter(F.col("depth") % BAND == BAND - 1)).select(F.col("node").alias("_node"), F.col("low").alias("_low")), "parents"
    )
    small = F.broadcast(parents) if parents.count() <= SMALL_ROWS else parents
    ready = (F.col("kind") == WHOLE)
    hanging = whole.unionByName(spine).filter(~ready).join(small, F.col("parent") == F.col("_node"), "left")
    hanging = hanging.withColumn("parent_conv_id", F.col("_low")).drop("_node", "_low")
    nodes = whole.unionByName(spine).filter(ready).unionByName(hanging)
    return nodes.select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", F.lower(F.hex("node")).alias("node"),
    )
