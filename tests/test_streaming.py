"""Streams against their batch twins, driven to the end of the input."""

import datetime as dt
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from casefile_spark.operators import ledger as L
from casefile_spark.operators import registry as K
from casefile_spark.plans import bindings as B
from casefile_spark.sources import sinks
from casefile_spark.streaming import batches, budgets, ingest, runs

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, folder, parts=3):
    """The rows in order of their first column, delivered as several files one after another."""
    first = df.columns[0]
    ranked = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(first)))
    for part in range(1, parts + 1):
        ranked.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source reads by modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_continuous_ingest_indexes_each_content_once(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    files = [(1, i, f"f{i}.pdf", f"text {i % 4} " * 5, day + dt.timedelta(minutes=i)) for i in range(8)] + [(2, 100, "o.pdf", "text 0 " * 5, day)]
    df = spark.createDataFrame(files, ingest.FILE_SCHEMA)
    landing, index = str(tmp_path / "in"), str(tmp_path / "index")
    df.coalesce(1).write.parquet(landing)
    for _ in range(2):  # the second run sees the same files again as one more delivery
        ingest.start_ingest(ingest.arriving_files(spark, landing), index, str(tmp_path / "checkpoint"), buckets=2).awaitTermination(120)
        df.coalesce(1).write.mode("append").parquet(landing)
    ingest.start_ingest(ingest.arriving_files(spark, landing), index, str(tmp_path / "checkpoint"), buckets=2).awaitTermination(120)
    got = sinks.read_chunks(spark, index)
    assert sorted((r.matter_id, r.text.split()[1]) for r in got.collect()) == [(1, "0"), (1, "1"), (1, "2"), (1, "3"), (2, "0")]


def test_batch_can_be_replayed(spark, tmp_path):
    index = str(tmp_path / "index")
    batch = spark.createDataFrame([(1, 1, "a", "same words", dt.datetime(2024, 1, 1))], ingest.FILE_SCHEMA).withColumn("content_sha256", F.sha2("text", 256))
    for _ in range(2):
        ingest.index_batch(batch, index, buckets=2)
    assert sinks.read_chunks(spark, index).count() == 1


def test_daily_budget_equals_batch(spark, tmp_path):
    events = B.events(spark, SF).select("ts", "event_id")
    out = drain(budgets.daily_budget(stream_of(spark, events, str(tmp_path / "e"))), "budget", "complete")
    want = {(r.day, r.calls) for r in L.daily_calls(events, "ts").collect()}
    assert {(r.day, r.calls) for r in out.collect()} == want


def test_tally_equals_batch(spark, tmp_path):
    calls = B.calls(spark, SF).select("run_id", F.col("seq.l_linenumber").alias("batch_no"), "input_tokens", "output_tokens", F.col("cost_usd").cast("decimal(12,2)").alias("cost_usd"))
    out = drain(runs.run_tally(stream_of(spark, calls, str(tmp_path / "c"))), "tally", "complete")
    want = {tuple(r) for r in runs.run_tally(calls).collect()}
    assert {tuple(r) for r in out.collect()} == want


def heartbeats(spark):
    def at(s):
        return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    rows = [(at(0), "quiet", 1, "running", 1), (at(20), "quiet", 1, "running", 2), (at(0), "fine", 2, "queued", 3), (at(60), "fine", 2, "running", 4), (at(100), "fine", 2, "done", 5),
            (at(110), "fine", 2, "running", 6), (at(5000), "clock", 3, "running", 7), (at(5001), "clock", 3, "failed", 8), (at(9000), "end", 4, "done", 9)]
    return spark.createDataFrame(rows, "at timestamp, run_id string, matter_id long, status string, event_id long")


def test_liveness_reports_silence_and_final_states(spark, tmp_path):
    ev = heartbeats(spark)
    with runs.keyed_state(spark):
        out = drain(runs.run_liveness(stream_of(spark, ev, str(tmp_path / "h"), parts=4)), "liveness", "append")
    last = {}
    for r in out.collect():
        last.setdefault(r.run_id, []).append(r.status)
    assert last["quiet"][-1] == "interrupted" and last["fine"][-1] == "done" and last["clock"][-1] == "failed"
    twin = {r.run_id: r.status for r in K.run_states(ev, F.lit("2024-01-01 03:00:00").cast("timestamp")).collect()}
    assert twin == {k: v[-1] for k, v in last.items()}


def plain_starts(rows):
    """One active run per matter, event by event."""
    held, known, out = {}, set(), []
    for at, run, matter, status, _ in sorted(rows, key=lambda r: (r[0], r[4])):
        holder, seen = held.get(matter, (None, None))
        if holder and (at - seen).total_seconds() > 120:
            holder = None
        if holder == run:
            held[matter] = (None if status in K.TERMINAL else run, at)
            continue
        if status in K.ACTIVE and (matter, run) not in known:
            known.add((matter, run))
            if holder is None:
                holder, seen = run, at
            out.append((matter, run, holder, holder == run))
        held[matter] = (holder, seen)
    return sorted(out)


def test_one_active_run_per_matter(spark, tmp_path):
    rng, at, rows = random.Random(8), dt.datetime(2024, 1, 1), []
    for i in range(300):
        at += dt.timedelta(seconds=rng.choice([1, 30, 30, 200]))
        rows.append((at, f"r{rng.randrange(40)}", rng.choice([1, 1, 1, 2]), rng.choice(["queued", "running", "running", "done", "failed"]), i))
    ev = spark.createDataFrame(rows, "at timestamp, run_id string, matter_id long, status string, event_id long")
    with runs.keyed_state(spark):
        out = drain(runs.active_runs(stream_of(spark, ev, str(tmp_path / "a"), parts=4)), "active", "append")
    got = sorted((r.matter_id, r.run_id, r.holder, r.granted) for r in out.collect())
    assert got == plain_starts(rows) and len({g[3] for g in got}) == 2


def test_a_run_is_forgotten_after_its_time(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at, "old", 1, "running", 1), (at + dt.timedelta(seconds=1), "old", 1, "done", 2), (at + dt.timedelta(days=40), "tick", 2, "done", 3),
            (at + dt.timedelta(days=80), "tock", 2, "done", 4), (at + dt.timedelta(days=81), "old", 1, "running", 5)]
    ev = spark.createDataFrame(rows, "at timestamp, run_id string, matter_id long, status string, event_id long")
    with runs.keyed_state(spark):
        out = drain(runs.run_liveness(stream_of(spark, ev, str(tmp_path / "f"), parts=5)), "forgotten", "append")
    assert [r.status for r in out.collect() if r.run_id == "old"][-1] in ("running", "interrupted")


def test_activity_spells_close_on_silence(spark, tmp_path):
    out = drain(runs.activity_spells(stream_of(spark, heartbeats(spark), str(tmp_path / "s"))), "spells", "append")
    assert {(r.run_id, r.beats) for r in out.collect() if r.run_id in ("quiet", "fine")} == {("quiet", 2), ("fine", 4)}


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    folder, schema = str(tmp_path / "out"), "run_id string, status string"
    first, second = (spark.createDataFrame([("r", s), (s, s)], schema) for s in ("running", "done"))
    for batch, rows in ((0, first), (1, second), (1, second)):
        batches.write_batch(folder, rows, batch)
    held = batches.read(spark, folder, first.schema)
    assert held.count() == 4
    assert {(r.run_id, r.status) for r in batches.latest(held, "run_id").collect()} == {("r", "done"), ("running", "running"), ("done", "done")}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = dt.datetime(2024, 1, 1, 12)
    for rows in ([day], [day + dt.timedelta(days=5)], [day, day + dt.timedelta(days=5)]):
        calls = spark.createDataFrame([(t,) for t in rows], "ts timestamp")
        calls.coalesce(1).write.mode("append").parquet(landing)
        budget = budgets.daily_budget(spark.readStream.schema(calls.schema).parquet(landing))
        batches.start(budget, "update", out, state).awaitTermination()
    got = batches.latest(batches.read(spark, out, budget.schema), "day").collect()
    assert {(r.day, r.calls) for r in got} == {(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 6), 2)}
