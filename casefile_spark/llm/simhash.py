"""Near-duplicates by SimHash with a pigeonring filter.

Documents with one fingerprint meet first, so that only different fingerprints are compared. A fingerprint is a ring of
segments. If two fingerprints differ in at most ``radius`` bits, some chain of consecutive segments starts at a segment
from which every beginning of the chain, of l segments, differs in at most ``l * radius / segments`` bits. Chains
of two segments are the join key: the first segment agrees and the second differs in no more bits than the budget of two
leaves. One side is indexed under what it holds, the other is looked up under every value within that budget. Pairs that
meet are checked along the whole chain and then in full.

In a group of fingerprints that meet under one key, only a spanning forest of its links is reported: linked classes stay
the same and output is linear in the group. A group is worked off in blocks.

``similar_documents`` is exact too, for sets of shingles and a Jaccard similarity, by a join on prefixes of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Workspace, by_ids
from .words import chunks, find_words

BITS = 64
BLOCK = 1024
RADIUS = 3
SEGMENTS = 4


def fingerprint(words: list[bytes], shingle: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), dtype=np.uint64, count=len(runs))
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(runs), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long) of whole lower-cased texts; null and blank texts have fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            # bytes.lower and bytes.split touch ASCII alone, and split at the ASCII white space
            found = np.array([fingerprint(t.as_py().lower().split(), shingle) if t.is_valid else 0 for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, fp long")


class Ring:
    """Segments of a fingerprint, and the budgets of chains of them."""

    def __init__(self, radius: int = RADIUS, segments: int = SEGMENTS):
        if BITS % segments or segments < 2:
            raise ValueError("segments must divide the fingerprint")
        self.radius, self.segments, self.width = radius, segments, BITS // segments
        self.budget = [length * radius // segments for length in range(segments + 1)]
        if self.budget[1]:
            raise ValueError("a chain must begin with a segment that agrees: take more segments than bits of the radius")

    def keys(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        """For each start, the key of the chain of two segments: the segments' bits, with the start in the upper bits."""
        return (self._key(fps, at) for at in range(self.segments))

    def _key(self, fps: np.ndarray, at: int) -> np.ndarray:
        turn = np.uint64(at * self.width)
        turned = fps if at == 0 else (fps >> turn) | (fps << np.uint64(BITS - at * self.width))
        mask = np.uint64((1 << min(2 * self.width, 58)) - 1)
        return (turned & mask) | np.uint64(at) << np.uint64(58)

    def near_keys(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        """The keys at which another fingerprint may be indexed whose second segment differs within the budget, but not nowhere."""
        for at in range(self.segments):
            own = self._key(fps, at)
            for n in range(1, self.budget[2] + 1):
                for bits in combinations(range(self.width, min(2 * self.width, 58)), n):
                    yield own ^ np.uint64(sum(1 << b for b in bits))

    def linked(self, a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
        """Which of ``a`` (rows) and ``b`` (columns) differ in at most ``radius`` bits, and along the ring from ``at`` stay within budget."""
        diff = a[:, None] ^ b[None, :]
        ok, total = np.ones(diff.shape, dtype=bool), np.zeros(diff.shape, dtype=np.uint8)
        mask = np.uint64((1 << self.width) - 1)
        for length in range(1, self.segments + 1):
            shift = np.uint64((at + length - 1) % self.segments * self.width)
            total += np.bitwise_count((diff >> shift) & mask)
            ok &= total <= self.budget[length]
        return ok


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _group_links(held: np.ndarray, near: np.ndarray, at: int, ring: Ring) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``held``, and between ``held`` and ``near``."""
    both = np.concatenate([held, near])
    forest, out = _Forest(both.size), []
    for i in range(0, held.size, BLOCK):
        for j in range(i, both.size, BLOCK):
            x, y = np.nonzero(ring.linked(both[i : min(i + BLOCK, held.size)], both[j : j + BLOCK], at))
            for p, q in zip((x + i).tolist(), (y + j).tolist()):
                if p < q and forest.link(p, q):
                    out.append((p, q))
    signed = both.view(np.int64)
    return [(int(signed[p]), int(signed[q])) for p, q in out]


def fingerprint_links(fps: DataFrame, ring: Ring) -> DataFrame:
    """``a``, ``b``: links between different fingerprints, enough to connect all that are within the radius.

    ``fps`` has distinct ``fp``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                fp = batch.column("fp").slice(lo, 2_000).to_numpy().view(np.uint64)
                for keys, near in ((ring.keys(fp), False), (ring.near_keys(fp), True)):
                    parts = list(keys)
                    if parts:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.full(fp.size * len(parts), near)), pa.array(np.tile(fp, len(parts)).view(np.int64))], names=["chain", "near", "fp"]
                        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def links(key: np.ndarray, near: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, key.size))
            held = np.add.reduceat((~near).astype(np.int64), first)
            out: list[tuple[int, int]] = []
            for lo, n, h in zip(first[(held > 0) & (size > 1)], size[(held > 0) & (size > 1)], held[(held > 0) & (size > 1)]):
                # the key's start is in its upper bits; what is held sorts before what is near
                out += _group_links(fp[lo : lo + h].view(np.uint64), fp[lo + h : lo + n].view(np.uint64), int(np.uint64(key[lo].view(np.uint64)) >> np.uint64(58)), ring)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"]) if out else None

        for batch in batches:
            now = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("chain", "near", "fp"))]
            end = int(np.searchsorted(now[0], now[0][-1])) if now[0].size else 0
            if end and (found := links(*(x[:end] for x in now))):
                yield found
            rest = [x[end:] for x in now]
        if rest[0].size and (found := links(*rest)):
            yield found

    dealt = fps.mapInArrow(deal, "chain long, near boolean, fp long")
    return dealt.repartition("chain").sortWithinPartitions("chain", "near").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; the component is the smallest ``doc_id`` reachable over links.
    Null and blank texts have fingerprint zero and link like any other. A null id belongs to its component, but names it only
    (as null) where all its ids are null. No rows give no rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.keep(fingerprints(docs, shingle), "prints")
    firsts = work.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "firsts")
    roots = components(fingerprint_links(firsts.select("fp"), Ring(radius, segments)), work)
    placed = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = work.keep(placed.join(lowest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_component(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs`` without those whose fingerprint is linked to that of a document with a smaller id, with all their columns.

    An id that several rows have goes only when all of them are linked so. Rows without id or words stay: a fingerprint of
    zero says nothing about a text.
    """
    work = Workspace(docs.sparkSession, "components")
    found = near_duplicates(docs.filter(F.col("text").rlike(r"[^ \t-\r]")), shingle, radius, segments)
    low = found.groupBy("doc_id").agg(F.max("component_id").alias("low"))
    return by_ids(docs, work.keep(low.filter("low < doc_id").select("doc_id"), "linked"), "doc_id", kept=False)


SAMPLE = 20_000
COMMON_CODES = 500_000
SKETCH_BITS = 2048
PAIR_BLOCK = 1024


def _lowered(column: pa.Array) -> pa.Array:
    return pa.array([t.as_py().lower() if t.is_valid else b"" for t in column.cast(pa.large_binary())], pa.large_binary()).view(pa.large_string())


def _shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct codes of each text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = find_words(_lowered(column))
    codes = words.codes()
    at, runs = words.runs(codes, shingle)
    cut, count = np.searchsorted(at, words.first), np.diff(words.first)
    short = words.spans(codes, words.first[:-1], np.where(count < shingle, words.first[1:], words.first[:-1]))
    return [np.unique(runs[cut[i] : cut[i + 1]]) if n >= shingle else short[i : i + 1][: int(n > 0)] for i, n in enumerate(count.tolist())]


def _common_codes(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, that recur in a sample of the texts, and how often. They only set an order of the shingles, which may be any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch]), "text"):
                codes, n = np.unique(np.concatenate(_shingle_sets(part.column("text"), shingle)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])

    share = SAMPLE / max(1, rows.count())
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)))
    met = drawn.mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter("n > 2")
    table = met.orderBy(F.col("n").desc(), "code").limit(COMMON_CODES).toArrow()
    codes, n = table["code"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def prefix(codes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first codes of a set in the order rare to common: two sets of at least ``similarity`` share one of them."""
    known, often = common
    seen = np.zeros(codes.size, np.int64)
    if known.size:
        at = np.minimum(np.searchsorted(known, codes), known.size - 1)
        seen = np.where(known[at] == codes, often[at], 0)
    return codes[np.lexsort((codes, seen))][: codes.size - int(np.ceil(similarity * codes.size - 1e-9)) + 1]


def sketch(codes: np.ndarray) -> bytes:
    """Parities of the codes by hash: two sketches differ in no more bits than the sets have codes that only one holds."""
    return np.packbits(np.bincount((codes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _possible(n_a, at_a, n_b, at_b, similarity: float):
    """Whether sets of ``n`` codes whose first common code stands at ``at`` can be similar enough: by their sizes and by what follows."""
    enough = similarity / (1 + similarity) * (n_a + n_b) - 1e-6
    return (np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - 1e-6) & (np.minimum(n_a - at_a, n_b - at_b) >= enough)


_PRINT = "doc_id long, digest binary, n long, prefix array<long>, sketch binary"


def _prints(sent, shingle: int, similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch]), "text"):
                rows = [(d, s) for d, s in zip(part.column("doc_id").to_pylist(), _shingle_sets(part.column("text"), shingle)) if s.size]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([d for d, _ in rows], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for _, s in rows], pa.binary()), pa.array([s.size for _, s in rows], pa.int64()),
                            pa.array([prefix(s, sent.value, similarity).view(np.int64) for _, s in rows], pa.list_(pa.int64())), pa.array([sketch(s) for _, s in rows], pa.binary()),
                        ],
                        names=["doc_id", "digest", "n", "prefix", "sketch"],
                    )

    return work


def _led(similarity: float):
    """Rows sorted by code and size: those whose code another row has, each with a possible partner of about its size, a leader.

    One row and one leader are carried from batch to batch, so a group of any size is read through, not held.
    """
    names = ("code", "n", "doc_id", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in names]
        lead, paired = None, False  # the leader of the held row's stretch; whether the row before it has its code

        def out(rows: list[np.ndarray], last: bool):
            nonlocal lead, paired
            code, n, doc, at = rows
            size = np.floor(np.log(n) / -np.log(similarity)).astype(np.int64)
            same = code[1:] == code[:-1]
            fresh = np.concatenate([[lead is None], ~same | (size[1:] != size[:-1])])
            first = np.maximum.accumulate(np.where(fresh, np.arange(code.size), -1))
            who = [np.where(first >= 0, x[first], 0 if lead is None else lead[k]) for k, x in enumerate((doc, n, at))]
            # the first of a stretch is led by the row before it
            begins = np.flatnonzero(fresh[1:] & same) + 1
            for x, y in zip(who, (doc, n, at)):
                x[begins] = y[begins - 1]
            ok = (who[0] != doc) & _possible(n, at, who[1], who[2], similarity)
            shared = np.concatenate([[paired], same]) | np.concatenate([same, [False]])
            end = code.size if last else code.size - 1
            if not last:
                f = first[-1]
                lead = lead if f < 0 else (doc[f], n[f], at[f])
                paired = bool(same[-1]) if same.size else paired
            keep = np.flatnonzero(shared[:end])
            arrays = [pa.array(x[keep]) for x in (code, n, doc, at)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(who[0][keep], mask=~ok[keep])], names=[*names, "leader"])

        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
                yield out(held, False)
                held = [h[-1:] for h in held]
        if held[0].size:
            yield out(held, True)

    return work


def _across(similarity: float, every: bool):
    """Rows sorted by code and pair of blocks: possible pairs of different roots; of each two roots the nearest alone, or all.

    A pair comes under the first code that both have: where an earlier one (``seen``) is common too, it has come there.
    """

    def pairs(table: pa.Table) -> list[np.ndarray]:
        lo, hi, block, n, at, doc, root = (table[c].to_numpy() for c in ("lo", "hi", "block", "n", "at", "doc_id", "root"))
        x = np.flatnonzero(block == lo[0])
        y = x if lo[0] == hi[0] else np.flatnonzero(block == hi[0])
        ok = (root[x][:, None] != root[y][None, :]) & _possible(n[x][:, None], at[x][:, None], n[y][None, :], at[y][None, :], similarity)
        if lo[0] == hi[0]:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        i, j = x[i], y[j]
        bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(lo), -1)
        apart = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[i[k : k + 20_000]] ^ bits[j[k : k + 20_000]]).sum(axis=1, dtype=np.int64) for k in range(0, i.size, 20_000))])
        near = apart <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-6
        i, j, apart = i[near], j[near], apart[near]
        if i.size:
            seen = [frozenset(c) for c in table["seen"].to_pylist()]
            first = np.fromiter((seen[x].isdisjoint(seen[y]) for x, y in zip(i.tolist(), j.tolist())), bool, i.size)
            i, j, apart = i[first], j[first], apart[first]
        if not every and i.size:
            one, two = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((apart, two, one))
            first = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])]
            i, j = i[first], j[first]
        return [np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, last: bool):
            key = [table[c].to_numpy() for c in ("code", "lo", "hi")]
            first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            ends = [*first[1:].tolist(), table.num_rows]
            found = [pairs(table.slice(a, b - a)) for a, b in list(zip(first.tolist(), ends))[: None if last else -1] if b - a > 1]
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]), table.slice(int(first[-1]))

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                found, rest = groups(now if rest is None else pa.concat_tables([rest, now]), False)
                yield found
        if rest is not None:
            yield groups(rest, True)[0]

    return work


def _similar(shingle: int, similarity: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(iter([batch]), "text_a"):
                sets = [_shingle_sets(part.column(name), shingle) for name in ("text_a", "text_b")]
                same = [np.intersect1d(a, b, assume_unique=True).size for a, b in zip(*sets)]
                ok = pa.array([n > 0 and n >= similarity * (a.size + b.size - n) for n, a, b in zip(same, *sets)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(ok)

    return check


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``component_id`` of the documents that are linked to another: sets of ``shingle``-word shingles of lower-cased
    texts whose Jaccard similarity is ``similarity`` or more. No link is lost, whatever the texts' length.

    Documents of one set are linked first and one of them goes on. A set's shingles are ordered from rare to common; two
    sets that are similar enough share one of the first (``prefix``), so documents meet there. First each is checked against a
    leader of about its size. Then, where documents of different components still meet, all pairs that sizes, places
    and sketches allow are checked: the nearest of each two components, and at last every one. Groups are cut into pairs of
    blocks that are rows of their own. Rows without id or words are left out; rows that repeat an id are one document, of
    the smallest text.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "similar")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    again = work.keep(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.head(1):
        one_each = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = work.keep(rows.join(again, "doc_id", "left_anti").unionByName(one_each), "rows")
    order = spark.sparkContext.broadcast(_common_codes(rows, shingle))
    prints = work.keep(rows.mapInArrow(_prints(order, shingle, similarity), _PRINT), "prints")
    firsts = work.keep(prints.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")
    links = work.keep(prints.select("doc_id", "digest").join(firsts, "digest").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "copies")
    alone = by_ids(prints, links, "b", kept=False)
    dealt = alone.select("doc_id", "n", F.posexplode("prefix").alias("at", "code")).select("code", "n", "doc_id", F.col("at").cast("long").alias("at"))
    met = dealt.repartition("code").sortWithinPartitions("code", "n", "doc_id").mapInArrow(_led(similarity), "code long, n long, doc_id long, at long, leader long")
    shared = work.keep(met, "shared")
    work.drop("firsts", "again")
    pairs = shared.filter("leader is not null").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    tested = None
    for step in ("led", "nearest", "every"):
        if step != "led":
            rooted = shared.drop("leader").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            live = rooted.groupBy("code").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
            live = rooted.join(live.select("code", F.ceil(F.col("size") / PAIR_BLOCK).alias("blocks")), "code")
            # What a document met under before: a prefix is ordered alike in all documents, so these come first for both.
            ordered = live.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("codes"))
            live = live.join(ordered, "doc_id").withColumn("seen", F.filter("codes", lambda x: x["at"] < F.col("at"))["code"]).drop("codes")
            live = live.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            live = live.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).join(prints.select("doc_id", "sketch"), "doc_id")
            live = live.select("code", "lo", "hi", "block", "n", "at", "doc_id", "root", "sketch", "seen").repartition("code", "lo", "hi").sortWithinPartitions("code", "lo", "hi")
            pairs = live.mapInArrow(_across(similarity, step == "every"), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = work.keep(pairs, f"pairs-{step}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        texts = work.keep(by_ids(rows, work.keep(ends, f"ends-{step}"), "doc_id", kept=True), f"texts-{step}")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        new = work.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(shingle, similarity), "a long, b long"), f"links-{step}")
        work.drop(f"texts-{step}", f"ends-{step}")
        if step != "led" and not new.head(1):
            continue
        links = links.unionByName(new)
        roots = components(links, Workspace(spark, f"similar-{step}"))
    found = work.keep(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "components")
    work.drop("prints", "shared", "copies", "rows", *(f"{kind}-{step}" for step in ("led", "nearest", "every") for kind in ("pairs", "links")))
    return found


def one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those linked to a document of a smaller id, with all their columns."""
    return by_ids(docs, similar_documents(docs, shingle, similarity).filter("doc_id <> component_id"), "doc_id", kept=False)
