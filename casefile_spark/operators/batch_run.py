"""Exhaustive runs from chunks to a finished answer, in attempts that can be resumed.

A run's chunks become the parts that its messages hold, headers included, and files are packed by the size of these parts, so
the estimate, the plan and the messages agree to the token. Each attempt sends the batches that have no answer yet and is
recorded in a folder of its own: an attempt that is recorded again replaces itself, and a batch that failed is sent again
alone, whatever became of the others. Model calls stay outside; their answers come back as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count
from . import exhaustive as E

RUN = ["run_id"]
BATCH = ["run_id", "batch_no"]
ATTEMPT = "run_id long, batch_no long, ok boolean, cancelled boolean, answer string, prompt_tokens long, completion_tokens long, error string, attempt int"


def sized_parts(chunks: DataFrame) -> DataFrame:
    """Message parts with their tokens. chunks: run_id, file_pos (dense from 0), filename, chunk_no (from 1), text."""
    return E.context_parts(chunks, RUN).withColumn("tokens", token_count(F.col("value")))


def plan_run(parts: DataFrame, budget: int = E.INPUT_BUDGET) -> DataFrame:
    """Files of every run with batch, tokens and chunks; a file's tokens are those of its parts as they will be sent."""
    files = parts.groupBy(*RUN, "file_pos").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("chunks"))
    return E.plan_batches(files, RUN, "file_pos", budget)


def batches_of(files: DataFrame) -> DataFrame:
    """One row per batch: files, chunks, context_tokens, and whether a file in it exceeds the budget."""
    return files.groupBy(*BATCH).agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.sum("tokens").alias("context_tokens"), F.bool_or("over_budget").alias("over_budget")
    )


def estimate(batches: DataFrame, model: Column, system_tokens: int, catalogue: DataFrame) -> DataFrame:
    """Cost and time bands per run, from what its messages hold."""
    return E.estimate_runs(batches.select(*BATCH, model.alias("model"), "files", "chunks", "context_tokens", F.lit(system_tokens).alias("system_tokens")), catalogue)


def pending(batches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Batches without an answer. A cancelled run has none pending."""
    stopped = attempts.filter("cancelled").select(*RUN).distinct()
    return batches.join(attempts.filter("ok").select(*BATCH).distinct(), BATCH, "left_anti").join(stopped, RUN, "left_anti")


def contexts(parts: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The message context of the wanted batches; a batch over the budget stays as parts and is left out here."""
    placed = parts.join(files.select(*RUN, "file_pos", "batch_no"), [*RUN, "file_pos"])
    return E.context_blocks(placed, wanted, BATCH)


def record(folder: str, answers: DataFrame, attempt: int) -> None:
    """Keep the answers of one attempt; recording it again replaces it and touches no other."""
    answers.withColumn("attempt", F.lit(attempt)).select(*[c.split()[0] for c in ATTEMPT.split(", ")[:-1]]).write.mode("overwrite").parquet(f"{folder}/attempt={attempt}")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts recorded so far; none is an empty table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ATTEMPT)
    return spark.read.schema(ATTEMPT).parquet(folder)


def outcomes(batches: DataFrame, tried: DataFrame) -> DataFrame:
    """The outcome of every batch that was tried: its first answer, else its last failure; with the number of attempts."""
    order = F.when(F.col("ok"), F.struct(F.lit(1).alias("good"), (-F.col("attempt")).alias("n"))).otherwise(F.struct(F.lit(0).alias("good"), F.col("attempt").alias("n")))
    row = F.struct("ok", "cancelled", "answer", "prompt_tokens", "completion_tokens", "error")
    best = tried.groupBy(*BATCH).agg(F.max_by(row, order).alias("_row"), F.count("*").alias("attempts"))
    return best.select(*BATCH, "attempts", "_row.*").join(batches.select(*BATCH, "files", "chunks"), BATCH)


def summary(done: DataFrame) -> DataFrame:
    """Totals of each run over its outcomes; failures cost what their calls reported."""
    return E.run_summary(done)


def answer_parts(done: DataFrame) -> DataFrame:
    """The run's answer as ordered parts, one per batch that has one."""
    return done.filter("ok").select(*BATCH, "answer")
