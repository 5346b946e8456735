"""Whole-corpus runs: token budgets, batches, prices, estimates and run summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.folds import next_fit
from ..functions.text import join_sorted, token_count

# Budgets, the provider adjustment, fallback prices (USD per million tokens, prompt
# and completion), output bands per chunk and seconds per batch.
INPUT_BUDGET = 400_000
PROMPT_OVERHEAD = 8_000
DENSE_PROVIDER = "anthropic/"
DENSE_FACTOR = 1.65
FALLBACK_PRICES = (
    ("anthropic/claude-opus-4.7", 5.00, 25.00),
    ("xiaomi/mimo-v2.5-pro", 0.43, 0.87),
    ("xiaomi/mimo-v2.5", 0.14, 0.28),
)
DEFAULT_PRICE = (5.00, 25.00)
OUT_LOW, OUT_LOW_PER_CHUNK = 2_000, 80
OUT_HIGH, OUT_HIGH_PER_CHUNK = 8_000, 300
SECONDS_LOW, SECONDS_HIGH = 90, 240
UNREAD = (
    "%d file(s) could not be read from the search index and were NOT included: %s. "
    "This analysis is not complete for this matter."
)
FAILED = (
    "%d of %d batches failed. These files were not fully analysed: %s. "
    "The results below cover the remaining files only."
)
CANCELLED = "Cancelled after %d of %d batches. The results below are partial."
SENT = "Exhaustive mode: %d passages from %d file(s) sent to %s. "
COLLAPSED = "%d exact per-file duplicate(s) collapsed."
NOT_COLLAPSED = "No per-file duplicates were collapsed."


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, token_count(F.col(text)))


def file_tokens(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("chunks"))


def plan_batches(files: DataFrame, keys: list[str], pos: str, budget: int = INPUT_BUDGET, segment_rows: int = 100_000) -> DataFrame:
    """Batch per file in the caller's order. A file above the budget stays whole and is flagged.

    files: keys..., <pos> dense from 0 within the keys, tokens.
    """
    usable = budget - PROMPT_OVERHEAD
    packed = next_fit(files, keys, pos, "tokens", usable, segment_rows=segment_rows).withColumnRenamed("pos", "_p")
    return (
        files.withColumn("_p", F.col(pos).cast("long"))
        .join(packed, [*keys, "_p"])
        .drop("_p")
        .withColumn("over_budget", F.col("tokens") > usable)
    )


# --- prices and cost -------------------------------------------------------------------------
def billing_tokens(counted: Column, model: Column) -> Column:
    return F.when(model.startswith(DENSE_PROVIDER), (counted * DENSE_FACTOR).cast("long")).otherwise(counted.cast("long"))


def fallback_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FALLBACK_PRICES, "model string, _fp double, _fc double")


def with_prices(usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Price per model: catalogue, then fallback table, then the conservative default.

    usage: model, ...; catalogue: id, prompt_per_million, completion_per_million.
    """
    listed = catalogue.filter(
        F.col("prompt_per_million").isNotNull() & F.col("completion_per_million").isNotNull()
    ).select(
        F.col("id").alias("model"), F.col("prompt_per_million").alias("_cp"), F.col("completion_per_million").alias("_cc")
    )
    return (
        usage.join(listed, "model", "left")
        .join(F.broadcast(fallback_prices(usage.sparkSession)), "model", "left")  # three rows
        .withColumn("price_in", F.coalesce("_cp", "_fp", F.lit(DEFAULT_PRICE[0])))
        .withColumn("price_out", F.coalesce("_cc", "_fc", F.lit(DEFAULT_PRICE[1])))
        .drop("_cp", "_cc", "_fp", "_fc")
    )


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * F.col("price_in") + tokens_out / 1e6 * F.col("price_out")


def estimate_runs(batches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Cost and time bands per run before it starts.

    batches: run_id, batch_no, model, files, chunks, context_tokens, system_tokens - measured on the
    assembled context, headers included.
    """
    run = batches.groupBy("run_id", "model").agg(
        F.sum("files").alias("files"),
        F.sum("chunks").alias("chunks"),
        F.sum(F.col("context_tokens") + F.col("system_tokens")).alias("_counted"),
        F.count("*").alias("batches"),
    )
    low = F.greatest(F.lit(OUT_LOW), F.col("chunks") * OUT_LOW_PER_CHUNK)
    high = F.greatest(F.lit(OUT_HIGH), F.col("chunks") * OUT_HIGH_PER_CHUNK)
    priced = with_prices(run.withColumn("input_tokens", billing_tokens(F.col("_counted"), F.col("model"))), catalogue)
    return priced.select(
        "run_id", "model", "files", "chunks", "batches", "input_tokens",
        cost(F.col("input_tokens"), low).alias("cost_low"),
        cost(F.col("input_tokens"), high).alias("cost_high"),
        (F.col("batches") * SECONDS_LOW).alias("seconds_low"),
        (F.col("batches") * SECONDS_HIGH).alias("seconds_high"),
    )


# --- after the run ---------------------------------------------------------------------------
def run_summary(outcomes: DataFrame) -> DataFrame:
    """outcomes: run_id, batch_no, ok, cancelled, chunks, prompt_tokens, completion_tokens."""
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("batches"),
        F.count_if(~F.col("ok")).alias("failed_batches"),
        F.sum("chunks").alias("total_chunks"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (F.bool_and("ok") & ~F.bool_or("cancelled")).alias("complete"),
        F.bool_or("cancelled").alias("cancelled"),
    )


def _names(rows: DataFrame, out: str) -> DataFrame:
    distinct = rows.select("run_id", F.col("filename").alias("value")).distinct()
    return distinct.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias(out), F.count("*").alias(f"{out}_n")
    )


def run_warnings(summary: DataFrame, batch_files: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Warnings per run, in order; the count of collapsed duplicates is always stated.

    summary: run_id, model, files, total_chunks, batches, failed_batches, cancelled, collapsed.
    batch_files: run_id, filename, ok. unreadable: run_id, filename.
    """
    failed = _names(batch_files.filter(~F.col("ok")), "failed_names")
    unread = _names(unreadable, "unread_names")
    done = F.col("batches") - F.col("failed_batches")
    tail = F.when(F.col("collapsed") > 0, F.format_string(COLLAPSED, "collapsed")).otherwise(F.lit(NOT_COLLAPSED))
    notes = F.array_compact(
        F.array(
            F.when(F.col("unread_names_n") > 0, F.format_string(UNREAD, "unread_names_n", "unread_names")),
            F.when(F.col("failed_batches") > 0, F.format_string(FAILED, "failed_batches", "batches", "failed_names")),
            F.when(F.col("cancelled"), F.format_string(CANCELLED, done, F.col("batches"))),
            F.concat(F.format_string(SENT, "total_chunks", "files", "model"), tail),
        )
    )
    return (
        summary.join(failed, "run_id", "left").join(unread, "run_id", "left")
        .select("run_id", F.posexplode(notes).alias("warning_no", "warning"))
    )


def context_parts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Context of an exhaustive batch as ordered parts: one header and text per chunk.

    chunks: keys..., file_pos, filename, chunk_no (from 1), text.
    """
    part = F.concat(
        F.lit("[SOURCE: "), F.col("filename"), F.lit(" chunk "), F.col("chunk_no").cast("string"), F.lit("]\n"), F.col("text")
    )
    return chunks.select(*keys, "file_pos", "chunk_no", part.alias("value"))


def context_blocks(parts: DataFrame, batches: DataFrame, keys: list[str]) -> DataFrame:
    """One context text per batch that fits the budget; over-budget batches stay as parts."""
    fitting = parts.join(batches.filter(~F.col("over_budget")).select(*keys).distinct(), keys, "left_semi")
    return fitting.groupBy(*keys).agg(
        join_sorted(F.collect_list(F.struct("file_pos", "chunk_no", "value")), "\n\n").alias("context")
    )
