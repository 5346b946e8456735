"""Running values per key that never need a whole key in one task.

A plain window puts every row of a key into one task, which fails when one key holds a large
share of the table. Here each key is cut into ordered segments (a day, a block of positions):
one aggregate row per segment is carried forward over the few segments of the key, and the
row-level window runs inside (key, segment) only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Running:
    """One running value: kind is sum, min, max, last (non-null) or previous (row before)."""

    kind: str
    value: Column
    out: str


def block_of(pos: Column, rows: int = 100_000) -> Column:
    return F.floor(pos / F.lit(rows))


def ranged(df: DataFrame, keys: list[str], order: list, rows: int = RANGE_ROWS) -> DataFrame:
    """The rows with ``_seg`` and ``_at``: the range they fall in when all are ordered by keys and order, and their place in it.

    Splitters come from the data: Spark samples keys and order, so a key with a third of all rows spreads over a third of
    the ranges, however its rows are dealt over days or names, and small keys share one. Rows equal in keys and order can't
    be split, so the order should end in an id. The ranges are written once, since a sample drawn twice may differ.
    """
    spark = df.sparkSession
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)
    placed = df.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    folder = shared_folder(spark, "ranges")
    placed.write.parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder).withColumn("_seg", F.shiftright("_at", 33))  # the id's upper bits number the task


def positions(df: DataFrame, keys: list[str], order: list, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``out``: the row's number within its key, from 1, without a window over the rows of a key.

    A range's rows of a key lie together, so a row's place minus the first one's counts them; rows of the key in earlier
    ranges are a running sum over one row per key and range.
    """
    held = ranged(df, keys, order, rows)
    per_range = held.groupBy(*keys, "_seg").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select(*keys, "_seg", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_seg"]]
    joined = held.alias("l").join(carried.alias("r"), same)
    return joined.select("l.*", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(out)).drop("_at", "_seg")


def one_segment(df: DataFrame, pos: str, rows: int) -> bool:
    """Whether every position lies in the first segment: then no key needs more than a window over its rows."""
    low, high = df.agg(F.min(pos), F.max(pos)).first()
    return low is None or (low >= 0 and high < rows)


def segmented(df: DataFrame, keys: list[str], segment: Column) -> DataFrame:
    """Cut into segments and shuffle the rows once; everything below reads that one shuffle."""
    return df.withColumn("_seg", segment).repartition(*keys, "_seg")


def running(df: DataFrame, keys: list[str], order: list[str], segment: Column | None, *wanted: Running) -> DataFrame:
    """Add the wanted running values; the segment must not decrease along ``order``.

    Without ``segment`` the rows were prepared by ``segmented`` and keep their segment column.
    """
    if segment is not None:
        df = segmented(df, keys, segment)
    for i, r in enumerate(wanted):
        df = df.withColumn(f"_v{i}", r.value)
    at = F.struct(*order)

    def summary(i: int, r: Running) -> Column:
        v = F.col(f"_v{i}")
        if r.kind == "last":
            out = F.max_by(v, F.when(v.isNotNull(), at))
        elif r.kind == "previous":
            out = F.max_by(v, at)
        else:
            out = {"sum": F.sum, "min": F.min, "max": F.max}[r.kind](v)
        return out.alias(f"_s{i}")

    per_segment = df.groupBy(*keys, "_seg").agg(*[summary(i, r) for i, r in enumerate(wanted)])
    over_segments = Window.partitionBy(*keys).orderBy("_seg")
    before = over_segments.rowsBetween(Window.unboundedPreceding, -1)

    def carry(i: int, r: Running) -> Column:
        s = F.col(f"_s{i}")
        if r.kind == "last":
            out = F.last(s, ignorenulls=True).over(before)
        elif r.kind == "previous":
            out = F.lag(s).over(over_segments)
        else:
            out = {"sum": F.sum, "min": F.min, "max": F.max}[r.kind](s).over(before)
        return out.alias(f"_c{i}")

    carried = per_segment.select(*keys, "_seg", *[carry(i, r) for i, r in enumerate(wanted)])
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    condition = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_seg"]]
    joined = df.alias("l").join(carried.alias("r"), condition, "left").select(
        "l.*", *[f"r._c{i}" for i in range(len(wanted))]
    )

    def combined(i: int, r: Running) -> Column:
        v, c = F.col(f"_v{i}"), F.col(f"_c{i}")
        if r.kind == "sum":
            out = F.sum(v).over(upto) + F.coalesce(c, F.lit(0))
        elif r.kind == "min":
            out = F.least(F.min(v).over(upto), c)
        elif r.kind == "max":
            out = F.greatest(F.max(v).over(upto), c)
        elif r.kind == "last":
            out = F.coalesce(F.last(v, ignorenulls=True).over(upto), c)
        else:
            out = F.when(F.row_number().over(inside) == 1, c).otherwise(F.lag(v).over(inside))
        return out.alias(r.out)

    gone = {f"_v{i}" for i in range(len(wanted))} | ({"_seg"} if segment is not None else set())
    keep = [c for c in df.columns if c not in gone]
    return joined.select(*keep, *[combined(i, r) for i, r in enumerate(wanted)])


def islands(df: DataFrame, keys: list[str], order: list[str], segment: Column, run_of: list[str], out: str) -> DataFrame:
    """Number consecutive runs of equal ``run_of`` values within a key, starting at 1.

    Inside a segment a row opens a run when it differs from the row before; whether the first row of
    a segment opens one is known from the last row of the segment before.
    """
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    at, now = F.struct(*order), F.struct(*run_of)
    df = segmented(df, keys, segment).withColumn("_turn", F.row_number().over(inside)).withColumn(
        "_opens", F.when((F.col("_turn") > 1) & ~F.lag(now).over(inside).eqNullSafe(now), 1).otherwise(0)
    )
    per_segment = df.groupBy(*keys, "_seg").agg(
        F.sum("_opens").alias("_n"), F.min_by(now, at).alias("_first"), F.max_by(now, at).alias("_last")
    )
    over_segments = Window.partitionBy(*keys).orderBy("_seg")
    before = over_segments.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.lag("_last").over(over_segments).eqNullSafe(F.col("_first")), 0).otherwise(1)
    based = per_segment.withColumn("_edge", edge).select(
        *keys, "_seg", (F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(before), F.lit(0)) + F.col("_edge")).alias("_base")
    )
    condition = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, "_seg"]]
    numbered = df.alias("l").join(based.alias("r"), condition).select("l.*", "r._base")
    run_no = F.col("_base") + F.sum("_opens").over(inside)
    return numbered.withColumn(out, run_no).drop("_seg", "_turn", "_opens", "_base")
