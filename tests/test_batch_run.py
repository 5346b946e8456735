"""Exhaustive runs: plan and messages agree to the token, attempts resume, replay and stop."""

import pytest
from pyspark.sql import functions as F

from casefile_spark.operators import batch_run as R
from casefile_spark.operators import exhaustive as E

BUDGET = E.PROMPT_OVERHEAD + 90


@pytest.fixture(scope="module")
def chunks(spark):
    """Files of 12, 8, 5 and 3 chunks, as the whole corpus of one run, and a file above the budget in another."""
    rows = [(1, f, f"f{f}.pdf", c + 1, f"text {f} {c}") for f, n in enumerate((12, 8, 5, 3)) for c in range(n)]
    rows += [(2, 0, "big file.pdf", 1, "word " * 100), (2, 1, "small.pdf", 1, "word")]
    return spark.createDataFrame(rows, "run_id long, file_pos long, filename string, chunk_no int, text string")


def answers(rows, ok):
    return rows.select(*R.BATCH, ok.alias("ok"), F.lit(False).alias("cancelled"), F.when(ok, F.lit("done")).alias("answer"), F.lit(7).cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"), F.when(~ok, "timeout").alias("error"))


def test_plan_counts_what_is_sent(spark, chunks):
    parts = R.sized_parts(chunks)
    files = R.plan_run(parts, BUDGET)
    batches = R.batches_of(files)
    assert {(b.run_id, b.batch_no): (b.files, b.chunks) for b in batches.collect()} == {(1, 0): (1, 12), (1, 1): (1, 8), (1, 2): (2, 8), (2, 0): (1, 1), (2, 1): (1, 1)}
    sent = {(r.run_id, r.batch_no): len(r.context.split()) for r in R.contexts(parts, files, batches).collect()}
    assert sent == {(b.run_id, b.batch_no): b.context_tokens for b in batches.filter("not over_budget").collect()}
    assert [b.over_budget for b in batches.filter("run_id = 2").orderBy("batch_no").collect()] == [True, False]
    costs = R.estimate(batches, F.lit("some/model"), 10, spark.createDataFrame([], "id string, prompt_per_million double, completion_per_million double")).collect()
    assert {c.run_id: c.input_tokens for c in costs}[1] == sum(v for k, v in sent.items() if k[0] == 1) + 30


def test_only_batches_without_an_answer_are_sent_again(spark, chunks, tmp_path):
    batches, folder = R.batches_of(R.plan_run(R.sized_parts(chunks), BUDGET)), str(tmp_path / "attempts")
    assert R.pending(batches, R.attempts(spark, folder)).count() == 5
    for _ in range(2):  # the first attempt is recorded twice, as after a lost driver
        R.record(folder, answers(batches, F.col("batch_no") != 1), 1)
    waiting = R.pending(batches, R.attempts(spark, folder))
    assert sorted((r.run_id, r.batch_no) for r in waiting.collect()) == [(1, 1), (2, 1)]
    R.record(folder, answers(waiting, F.col("run_id") == 1), 2)
    done = R.outcomes(batches, R.attempts(spark, folder))
    assert {(r.run_id, r.batch_no): (r.ok, r.attempts, r.error) for r in done.collect()} == {
        (1, 0): (True, 1, None), (1, 1): (True, 2, None), (1, 2): (True, 1, None), (2, 0): (True, 1, None), (2, 1): (False, 2, "timeout")}
    totals = {r.run_id: (r.batches, r.failed_batches, r.total_chunks, r.complete) for r in R.summary(done).collect()}
    assert totals == {1: (3, 0, 28, True), 2: (2, 1, 2, False)}
    assert R.answer_parts(done).count() == 4


def test_a_cancelled_run_sends_nothing_more(spark, chunks, tmp_path):
    batches, folder = R.batches_of(R.plan_run(R.sized_parts(chunks), BUDGET)), str(tmp_path / "attempts")
    R.record(folder, answers(batches.filter("run_id = 1 AND batch_no = 0"), F.lit(False)).withColumn("cancelled", F.lit(True)), 1)
    assert {r.run_id for r in R.pending(batches, R.attempts(spark, folder)).collect()} == {2}
