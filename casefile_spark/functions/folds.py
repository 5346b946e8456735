"""Ordered next-fit packing: keep items whole, open a new batch when the next one would not fit.

The reset point depends on the data before it, so a window sum cannot express it. A key is cut
into position segments. Each segment reports, for every possible first reset inside it, what the
open batch holds at its end; those short reports are chained per key; then every segment numbers
its own rows. No task sees more than one segment of items or one key's reports. Where every key lies
in one segment, nothing is carried, and the many short keys of an Arrow batch are packed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 100_000


def _first_over(sums: np.ndarray, limit) -> np.ndarray:
    """First position whose inclusive prefix sum exceeds the limit."""
    return np.searchsorted(sums, limit, side="right")


def _report(sizes: np.ndarray, budget: int, reset: int):
    """Possible first resets of a segment: prefix sum there, running size and resets at its end."""
    n, upto = len(sizes), np.cumsum(sizes)
    before = upto - sizes
    nxt = np.maximum(np.arange(n) + 1, _first_over(upto, budget - reset + before))
    hops = (nxt < n).astype(np.int64)
    jump = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        hops, jump = hops + hops[jump], further
    end = reset + upto[-1] - before[jump]
    last = min(int(_first_over(upto, budget)), n - 1)
    _, first_of = np.unique(upto[: last + 1], return_index=True)
    return upto[first_of], end[first_of], hops[first_of] + 1, int(upto[-1])


def _starts(sizes: np.ndarray, budget: int, running: int, reset: int, fresh: bool) -> list[int]:
    """Positions in the segment where a new batch opens."""
    n, upto = len(sizes), np.cumsum(sizes)
    j = int(_first_over(upto, budget - running))
    j = max(j, 1) if fresh else j
    found = []
    while j < n:
        found.append(j)
        j = max(j + 1, int(_first_over(upto, budget - reset + upto[j] - sizes[j])))
    return found


def _openings(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows that differ from the row before in any of the columns; nulls are equal to nulls."""
    opens = np.zeros(table.num_rows, dtype=bool)
    opens[:1] = True
    for c in columns:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        opens[1:] |= codes[1:] != codes[:-1]
    return opens


def _side_by_side(table: pa.Table, keys: list[str], budget: int) -> pa.Table:
    """Whole keys, sorted by key and position, with their batch numbers: all keys take their next step at once."""
    n, starts = table.num_rows, np.flatnonzero(_openings(table, keys))
    lengths = np.diff(np.append(starts, n))
    end, start = np.repeat(starts + lengths, lengths), np.repeat(starts, lengths)
    sizes, initial, reset = (table[c].to_numpy() for c in ("size", "initial", "reset"))
    upto = np.cumsum(sizes)
    before = upto - sizes
    nxt = np.maximum(np.arange(n) + 1, _first_over(upto, budget - reset[start] + before))
    at = np.maximum(starts + 1, _first_over(upto, budget - initial[starts] + before[starts]))
    flags = np.zeros(n, dtype=np.int64)
    at = at[at < end[starts]]
    while at.size:
        flags[at] = 1
        at, last = nxt[at], end[at]
        at = at[at < last]
    opened = np.cumsum(flags)
    batch = opened - opened[start]
    # Rows of one position meet every number of that position, as a join by position gives them.
    places = np.flatnonzero(_openings(table, [*keys, "pos"]))
    held = np.diff(np.append(places, n))
    out = table.drop_columns(["size", "initial", "reset"])
    if len(places) < n:
        times, first = np.repeat(held, held), np.repeat(places, held)
        rows = np.repeat(np.arange(n), times)
        turn = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        out, batch = out.take(pa.array(rows)), batch[first[rows] + turn]
    return out.append_column("batch_no", pa.array(batch, pa.int64()))


def pack_short(
    df: DataFrame, keys: list[str], pos: str, size: str, budget: int, keep: list[str], initial: Column | None = None, reset: Column | None = None,
) -> DataFrame:
    """``next_fit`` for keys that each lie in one segment: keys, pos, keep..., batch_no of every row with a position.

    A task reads its sorted keys once and packs those of an Arrow batch together, so a short key costs no call of its own.
    """
    zero = F.lit(0)
    ordered = Window.partitionBy(*keys).orderBy("pos")  # brings a key's rows together, in order
    items = df.filter(F.col(pos).isNotNull()).select(
        *keys,
        F.col(pos).cast("long").alias("pos"),
        F.col(size).cast("long").alias("size"),
        (initial if initial is not None else zero).cast("long").alias("initial"),
        (reset if reset is not None else zero).cast("long").alias("reset"),
        *keep,
    ).withColumn("_turn", F.row_number().over(ordered))
    names = [*keys, "pos", "size", "initial", "reset", *keep]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            table = table if rest is None else pa.concat_tables([rest, table])
            whole = int(np.flatnonzero(_openings(table, keys))[-1]) if table.num_rows else 0
            if whole:  # the last key may go on in the next batch
                yield from _side_by_side(table.slice(0, whole).combine_chunks(), keys, budget).to_batches()
            rest = table.slice(whole)
        if rest is not None and rest.num_rows:
            yield from _side_by_side(rest.combine_chunks(), keys, budget).to_batches()

    out = items.select(*keys, "pos", *keep).schema
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out)
    return items.mapInArrow(pack, ddl + "batch_no long")


def next_fit(
    df: DataFrame,
    keys: list[str],
    pos: str,
    size: str,
    budget: int,
    initial: Column | None = None,
    reset: Column | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Batch number (from 0) for every (keys, pos); ``pos`` counts densely within a key.

    ``initial`` and ``reset`` are the sizes already spent when the first and any later batch opens.
    """
    zero = F.lit(0)
    items = df.select(
        *keys,
        F.col(pos).cast("long").alias("pos"),
        F.col(size).cast("long").alias("size"),
        (initial if initial is not None else zero).cast("long").alias("initial"),
        (reset if reset is not None else zero).cast("long").alias("reset"),
        F.floor(F.col(pos) / segment_rows).cast("long").alias("seg"),
    ).repartition(*keys, "seg")  # both passes over the segments read this one shuffle
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)

    def report(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        first = table.slice(0, 1)
        sizes = table["size"].to_numpy()
        seg, init, again = (first[c][0].as_py() for c in ("seg", "initial", "reset"))
        sums, ends, resets, total = _report(sizes, budget, again)
        if seg == 0:  # nothing carried in: one known outcome
            opened = _starts(sizes, budget, init, again, True)
            end = again + int(sizes[opened[-1] :].sum()) if opened else init + total
            sums, ends, resets, total = [], [end], [len(opened)], total
        out = first.select(keys)
        for name, value, kind in (
            ("seg", seg, pa.int64()),
            ("total", total, pa.int64()),
            ("sums", list(map(int, sums)), pa.list_(pa.int64())),
            ("ends", list(map(int, ends)), pa.list_(pa.int64())),
            ("resets", list(map(int, resets)), pa.list_(pa.int64())),
        ):
            out = out.append_column(name, pa.array([value], kind))
        return out

    reports = items.groupBy(*keys, "seg").applyInArrow(
        report, key_ddl + "seg long, total long, sums array<long>, ends array<long>, resets array<long>"
    )

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg").combine_chunks()
        carry, base, running, opened = [], [], 0, 0
        for row in table.select(["seg", "total", "sums", "ends", "resets"]).to_pylist():
            carry.append(running)
            base.append(opened)
            if row["seg"] == 0:
                running, opened = row["ends"][0], row["resets"][0]
                continue
            j = int(_first_over(np.asarray(row["sums"]), budget - running))
            if j < len(row["sums"]):
                running, opened = row["ends"][j], opened + row["resets"][j]
            else:
                running += row["total"]
        out = table.select([*keys, "seg"])
        return out.append_column("carry", pa.array(carry, pa.int64())).append_column("base", pa.array(base, pa.int64()))

    carried = reports.groupBy(*keys).applyInArrow(chain, key_ddl + "seg long, carry long, base long")

    def number(table: pa.Table, brought: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        sizes = table["size"].to_numpy()
        seg, init, again = (table[c][0].as_py() for c in ("seg", "initial", "reset"))
        carry, base = brought["carry"][0].as_py(), brought["base"][0].as_py()
        flags = np.zeros(len(sizes), dtype=np.int64)
        flags[_starts(sizes, budget, init if seg == 0 else carry, again, seg == 0)] = 1
        return table.select([*keys, "pos"]).append_column("batch_no", pa.array(base + np.cumsum(flags), pa.int64()))

    return (
        items.groupBy(*keys, "seg")
        .cogroup(carried.groupBy(*keys, "seg"))
        .applyInArrow(number, key_ddl + "pos long, batch_no long")
    )
