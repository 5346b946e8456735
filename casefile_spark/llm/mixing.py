"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source has a target in words. A document's key is an exponential variate divided by its quality weight; in the
order of the keys the documents of a source fill its budget. Complete epochs come first: a target of 2.4 times the
source's size takes every document twice and fills the remaining 0.4 in key order, cutting the last document to fit.

No source is sorted whole: quantiles of the keys split it into ranges, sums over the ranges tell which range the budget
ends in, and only that range is looked at again, until it is small enough to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
RANGE_ROWS = 2_000
RANGES = 256
MAX_ROUNDS = 6
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|!]"


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by the id and the seed, from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target``: all words shared by weight, none above ``max_epochs`` times its size.

    Sources come by code point, null last, and take the weights in turn. A source is capped when the level left by the
    sources that fill up before it would still take it past its cap; the level of the first that is not capped holds
    for all others. This is where resharing the excess again and again ends. The window is over sources, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") < F.col("level"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    fair = F.coalesce(first["level"], F.lit(0.0)) * F.col("weight")
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(fair, F.col("cap").cast("double"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _cut(rows: DataFrame, goals: DataFrame, work: Workspace) -> DataFrame:
    """Per source the keys between which the budget ends, and the budget left at the lower one."""
    spans = goals.select("source", "part", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.col("part").alias("left"))
    for step in range(MAX_ROUNDS):
        inside = _inside(rows, spans)
        counts = work.keep(inside.groupBy("source").agg(F.count("*").alias("rows"), F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], RANGES * 40).alias("bounds")), f"bounds{step}")
        if (counts.agg(F.max("rows")).first()[0] or 0) <= RANGE_ROWS:
            break
        bounds = counts.select(F.col("source").alias("s"), F.array_distinct("bounds").alias("bounds"))
        held = inside.join(bounds, _same(F.col("source"), F.col("s"))).drop("s")
        held = held.withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("key"))))
        held = held.groupBy("source", "range").agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.first("left").alias("left"))
        order = Window.partitionBy("source").orderBy("range")
        sums = held.withColumn("before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ends = sums.filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left")))
        ends = work.keep(ends.select(F.col("source").alias("s"), F.col("low").alias("new_lo"), F.col("high").alias("new_hi"), F.col("before")), f"ends{step}")
        spans = spans.join(ends, _same(F.col("source"), F.col("s")), "left").select(
            "source", "part", *[F.coalesce(c, F.lit(float("inf"))).alias(a) for c, a in (("new_lo", "lo"), ("new_hi", "hi"))], F.coalesce(F.col("left") - F.col("before"), F.lit(0)).alias("left")
        )  # no end: the budget takes every document
        spans = work.keep(spans, f"spans{step}")
    return spans


def _inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnRenamed("source", "s")
    return rows.join(spans, _same(F.col("source"), F.col("s")) & F.col("key").between(F.col("lo"), F.col("hi"))).drop("s")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1: documents with many mark-up symbols for their words weigh less."""
    return F.when(size > 0, 1.0 / (1.0 + 8.0 * F.regexp_count(text, F.lit(SYMBOL)).cast("double") / size.cast("double"))).otherwise(F.lit(1.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``epochs``, ``taken``.

    ``size`` counts the words of the whole text (null: 0), ``taken`` the words the mix takes of it, repeats counted.
    A null source is a source of its own. Documents without words and tables without words get 0. Rows that repeat an
    id have one key and are taken in the order of their size. Other columns are not read.
    """
    work = Workspace(docs.sparkSession, "mixing")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("size", F.regexp_count("text", F.lit(WORD)).cast("long"))
    rows = rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / quality_weight(F.col("text"), F.col("size"))).alias("key"))
    rows = work.keep(rows, "rows")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("part", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    goals = work.keep(goals, "goals")
    spans = work.keep(_cut(rows, goals, work), "cut")
    names = goals.columns
    plan = goals.join(spans.select(F.col("source").alias("s"), "lo", "hi", "left"), _same(F.col("source"), F.col("s"))).drop("s", "part")
    plan = work.keep(plan.select(*[F.col(c).alias(f"g_{c}") if c == "source" else F.col(c) for c in names if c != "part"], "lo", "hi", "left"), "plan")
    joined = rows.join(plan, _same(F.col("source"), F.col("g_source"))).drop("g_source")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = joined.filter(F.col("key").between(F.col("lo"), F.col("hi"))).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before"))))
    rest = joined.filter(~F.col("key").between(F.col("lo"), F.col("hi"))).withColumn("before", F.lit(0).cast("long"))
    rest = rest.withColumn("extra", F.when(F.col("key") < F.col("lo"), F.col("size")).otherwise(F.lit(0)))
    out = rest.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra").unionByName(last.select("doc_id", "source", "size", "source_size", "target", "epochs", "extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))
