"""Sinks: ledger CSV, chunk index, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_index import ChunkIndex

# The ledger CSV columns, in order.
CSV_COLUMNS = (
    "timestamp_utc", "date_local", "matter_id", "matter_name", "task_id", "model",
    "exhaustive", "status", "input_tokens", "output_tokens", "cost_usd", "duration_seconds",
)


def ledger_csv_rows(rows: DataFrame, time_zone: str = "UTC") -> DataFrame:
    """The ledger as text columns; the local date follows the given time zone."""
    def text(name: str, empty: str = "") -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(empty))

    seconds = F.col("duration_seconds").cast("double")
    local = F.date_format(F.from_utc_timestamp("timestamp", time_zone), "yyyy-MM-dd")
    values = (
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        local,
        text("matter_id"),
        text("display_matter"),
        text("task_id"),
        text("model_used"),
        F.when(F.coalesce("was_exhaustive", F.lit(False)), "true").otherwise("false"),
        text("status"),
        text("input_tokens", "0"),
        text("output_tokens", "0"),
        F.coalesce(F.round(F.col("cost_usd").cast("decimal(18,6)"), 4).cast("decimal(18,4)").cast("string"), F.lit("")),
        F.when(seconds.isNull(), F.lit("")).otherwise(F.format_string("%.1f", F.bround(seconds, 1))),
    )
    return rows.select(*[c.alias(n) for c, n in zip(values, CSV_COLUMNS)])


def write_ledger_csv(rows: DataFrame, folder: str, time_zone: str = "UTC") -> None:
    """CSV with header; the first header name carries the byte-order mark spreadsheets look for."""
    out = ledger_csv_rows(rows, time_zone)
    marked = out.withColumnRenamed(CSV_COLUMNS[0], "﻿" + CSV_COLUMNS[0])
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def replace_files(folder: str, chunks: DataFrame, gone: DataFrame | None = None, buckets: int = 256, write_id: str | None = None) -> int:
    """A new version of the index in which the files in ``chunks`` have these chunks and those in ``gone`` none (see ``ChunkIndex``)."""
    return ChunkIndex(chunks.sparkSession, folder, buckets).write(chunks, gone, write_id)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of the index."""
    return ChunkIndex(spark, folder).read()


def index_metadata(chunks: DataFrame) -> DataFrame:
    """Per collection: chunk count, vector size and model the vectors came from."""
    return chunks.groupBy("collection").agg(
        F.count("*").alias("chunks"),
        F.max(F.size("embedding")).alias("dim"),
        F.first("embed_model", ignorenulls=True).alias("embed_model"),
        F.first("content_sha256", ignorenulls=True).alias("content_sha256"),
    )


def write_result_tables(cells: DataFrame, folder: str, version: int = 0) -> None:
    """Result tables of one write: one folder per version and task, titles stay a column.

    Earlier versions are never touched. Writing a version again replaces it, so that a repeated write
    changes nothing.
    """
    (
        cells.withColumn("version", F.lit(version)).hint("rebalance", "task")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "task").parquet(folder)
    )


def read_result_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every result."""
    held = spark.read.parquet(folder)
    latest = held.groupBy("result_id").agg(F.max("version").alias("version"))
    return held.join(latest, ["result_id", "version"], "left_semi").drop("version")
