"""Registered streams, driven to the end of the given tables, with the SQL of their final state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.sinks import read_chunks
from ..streaming import batches, budgets, ingest, runs
from . import bindings as B
from .corpus_queries import _windows


def _stream(spark, sf, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")
    local = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def _settled(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Run to the end of the input into a shared table: all rows of an append stream, or the latest row
    per ``key`` of an update stream."""
    spark = df.sparkSession
    folder, state = shared_folder(spark, name), shared_folder(spark, f"{name}-checkpoint")
    batches.start(df, "update" if key else "append", folder, state).awaitTermination()
    held = batches.read(spark, folder, df.schema)
    return batches.latest(held, key) if key else held.drop("batch")


def l1_ingest_stream(spark, sf):
    """All documents arrive as files; the index holds each content of a matter once."""
    d = _stream(spark, sf, "documents")
    files = d.select(
        B.matter_of(F.col("source")).alias("matter_id"), F.col("doc_id").alias("file_id"), F.concat("lang", F.lit(".pdf")).alias("filename"), "text",
        F.lit("2024-01-01").cast("timestamp").alias("arrived_at"), F.sha2("text", 256).alias("content_sha256"),
    )
    index = shared_folder(spark, "stream-index")
    ingest.start_ingest(files, index, shared_folder(spark, "stream-index-checkpoint"), buckets=2).awaitTermination()
    return read_chunks(spark, index).groupBy("matter_id").agg(
        F.count_distinct("content_sha256").alias("contents"), F.count("*").alias("chunks"), F.count_distinct("file_id").alias("files")
    )


def _run_beats(spark, sf):
    """Events as beats of runs: a user is a run, ten matters share them."""
    status = (
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "queued").otherwise("running")
    )
    return _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), (F.col("user_id") % 10).alias("matter_id"), status.alias("status"), F.col("ts").alias("at"), "event_id"
    )


def l2_liveness_stream(spark, sf):
    """The last reported status of every run over the heartbeat stream."""
    with runs.keyed_state(spark):
        out = _settled(runs.run_liveness(_run_beats(spark, sf)), "liveness")
    late = F.when(F.col("status") == "interrupted", 1).otherwise(0)
    return out.groupBy("run_id").agg(F.max_by("status", F.struct(late, "last_seen")).alias("status"))


def l2_active_run_stream(spark, sf):
    """Every run's start, and whether it got its matter or which run held it."""
    with runs.keyed_state(spark):
        out = _settled(runs.active_runs(_run_beats(spark, sf)), "active")
    return out.select("matter_id", "run_id", "holder", "granted", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def l3_tally_stream(spark, sf):
    li = _stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("batch_no"), F.col("l_quantity").cast("long").alias("input_tokens"),
        F.floor("l_extendedprice").alias("output_tokens"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost_usd"),
    )
    out = _settled(runs.run_tally(li), "tally", "run_id")
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


def l4_daily_budget_stream(spark, sf):
    out = _settled(budgets.daily_budget(_stream(spark, sf, "events")), "budget", "day")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "state")


QUERIES = {f.__name__: f for f in (l1_ingest_stream, l2_liveness_stream, l2_active_run_stream, l3_tally_stream, l4_daily_budget_stream)}

SQL = {
    "l1_ingest_stream": f"""
WITH src AS (SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id, sha256(text) AS sha, any_value(text) AS text FROM documents GROUP BY 1, 2),
{_windows('src', 'matter_id, sha')}
SELECT matter_id, count(DISTINCT sha) AS contents, count(*) AS chunks, count(DISTINCT sha) AS files FROM chunk GROUP BY matter_id""",
    "l2_liveness_stream": """
WITH ev AS (SELECT user_id::VARCHAR AS run_id, ts, event_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status FROM events),
g AS (SELECT run_id, max(ts) AS seen, arg_max(status, (ts, event_id)) AS last, arg_min(status, (ts, event_id)) FILTER (status IN ('done', 'failed')) AS ended FROM ev GROUP BY 1)
SELECT run_id, CASE WHEN ended IS NOT NULL THEN ended WHEN seen + INTERVAL 130 SECOND < (SELECT max(ts) FROM events) THEN 'interrupted' ELSE last END AS status FROM g""",
    "l3_tally_stream": """
SELECT l_orderkey AS run_id, max(l_linenumber) AS batches_done, sum(l_quantity::BIGINT) AS input_tokens, sum(floor(l_extendedprice)::BIGINT) AS output_tokens,
  CASE WHEN count(*) = count(*) FILTER (l_discount > 0) THEN sum(l_extendedprice::DECIMAL(18, 2)) END::DOUBLE AS cost_usd FROM lineitem GROUP BY 1""",
    "l4_daily_budget_stream": """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM events GROUP BY 1)
SELECT day, calls, CASE WHEN calls >= 4900 THEN 'stop' WHEN calls >= 4000 THEN 'warn' ELSE 'ok' END AS state FROM d""",
}
