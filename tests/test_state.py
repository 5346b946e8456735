"""Quality, registry, ledger and exhaustive runs on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casefile_spark.operators import exhaustive as E
from casefile_spark.operators import ledger as L
from casefile_spark.operators import quality as Q
from casefile_spark.operators import registry as K


def at(text):
    return dt.datetime.fromisoformat(text)


def test_extraction_verdict(spark):
    files = spark.createDataFrame([(i,) for i in range(1, 6)], "file_id int")
    pages = spark.createDataFrame([(1, "short", False), (2, "short", True), (3, "x" * 400, True), (3, "x" * 400, False), (4, "─" * 200, True)], "file_id int, text string, is_ocr boolean")
    got = {r.file_id: (r.quality, r.quality_detail) for r in Q.extraction_verdict(files, pages).collect()}
    assert got[1] == ("ok", "") and got[3] == ("ok", "") and got[5] == ("failed_no_text", Q.NO_TEXT)
    assert got[2][0] == "ocr_low_quality" and "only 5 characters" in got[2][1]
    assert got[4][0] == "ocr_low_quality" and got[4][1].startswith("Only 0% of")


def test_upload_actions(spark):
    staged = spark.createDataFrame([(1, 100, "a"), (1, 101, "b"), (1, 102, "c"), (1, 103, "c"), (2, 104, "a")], "matter_id int, upload_id int, content_sha256 string")
    held = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", at("2024-01-01"))], "matter_id int, file_id int, content_sha256 string, deleted_at timestamp")
    got = {r.upload_id: (r.action, r.existing_file_id) for r in Q.upload_actions(staged, held).collect()}
    assert got == {100: ("duplicate", 1), 101: ("restore", 2), 102: ("insert", None), 103: ("duplicate", None), 104: ("insert", None)}


def test_health_reconcile(spark):
    files = spark.createDataFrame([(1, 1, "healthy", "ingested"), (2, 1, "gone", "ingested"), (3, 1, "hollow", "ocr_low_quality"), (4, 1, "odd", "failed")], "file_id int, matter_id int, collection string, ingest_status string")
    index = spark.createDataFrame([("healthy",), ("hollow",)], "collection string")
    chunks = spark.createDataFrame([("healthy", [1.0, 2.0])], "collection string, embedding array<float>")
    probed = Q.probe_indexes(files, index, chunks, 2)
    assert Q.health_summary(probed).first().asDict() == {"checked": 3, "demoted": 2}
    assert {r.file_id: r.ingest_error for r in Q.reconcile_health(probed).collect()} == {
        2: "Its search index is missing. Re-upload this file to make it searchable again.", 3: "Its search index contains no text. Re-upload this file to make it searchable again."}
    assert Q.reconcile_health(probed, store_available=False).count() == 0
    assert Q.probe_indexes(files, index, chunks, 3).filter("state = 'unreadable'").count() == 1


def test_reprocess(spark):
    files = spark.createDataFrame([(1, 1, "ingested"), (2, 1, "failed"), (3, 2, "failed"), (4, 1, "password_protected")], "file_id int, matter_id int, ingest_status string")
    assert {r.file_id for r in Q.files_to_reprocess(files, 1).collect()} == {2, 4}
    assert [r.file_id for r in Q.files_to_reprocess(files, 1, 1).collect()] == [1]


@pytest.mark.parametrize("name, start, end", [
    ("2026-03-27 - Technician Report Form.pdf", "2026-03-27", None), ("2026-01-21 - 2026-03-26 - Condo manage.pdf", "2026-01-21", "2026-03-26"),
    ("2024-04-01 to 2026-04-30 - email.pdf", "2024-04-01", "2026-04-30"), ("2024-03-15_letter.pdf", "2024-03-15", None), ("24-03-15_letter.pdf", "2024-03-15", None),
    ("2024.03.15 letter.pdf", "2024-03-15", None), ("69-01-01 x.pdf", "2069-01-01", None), ("70-01-01 x.pdf", "1970-01-01", None), ("3-15-24_letter.pdf", None, None),
    ("letter_24-03-15.pdf", None, None), ("23_march_letter.pdf", None, None), ("letter.pdf", None, None), ("2024-02-30 impossible.pdf", None, None),
    ("2024-13-01 impossible.pdf", None, None), ("2024-03-15x.pdf", None, None), ("2024-3-5.pdf", "2024-03-05", None),
])
def test_date_prefix(spark, name, start, end):
    p = spark.createDataFrame([(name,)], "n string").select(K.date_prefix(F.col("n")).alias("p")).first().p
    assert (str(p.start) if p else None) == start and (str(p.end) if p and p.end else None) == end


def test_file_orders(spark):
    names = ["b.pdf", "2024-01-02 z.pdf", "A.pdf", "2023-05-05 y.pdf", "2024-01-02 a.pdf"]
    files = spark.createDataFrame([(i, n, at("2024-01-01") - dt.timedelta(days=i)) for i, n in enumerate(names)], "file_id int, filename string, created_at timestamp")
    order = {o: [r.file_id for r in K.sort_files(files, o).collect()] for o in ("oldest", "newest", "upload", "bogus")}
    assert order["oldest"] == order["bogus"] == [3, 4, 1, 2, 0] and order["newest"] == [1, 4, 3, 2, 0] and order["upload"] == [4, 3, 2, 1, 0]


def test_deletion_window(spark):
    df = spark.createDataFrame([(at("2024-01-31 12:00"),), (at("2024-01-02"),), (at("2023-01-01"),), (None,)], "d timestamp")
    as_of = F.lit("2024-02-01").cast("timestamp")
    assert [r[0] for r in df.select(K.days_remaining(F.col("d"), as_of)).collect()] == [30, 0, 0, 30]


def test_state_events_and_names(spark):
    rows = spark.createDataFrame([(1, "Imperial"), (2, "Crest"), (3, "New")], "matter_id int, name string")
    events = spark.createDataFrame([(1, "delete", at("2024-01-01"), 1), (1, "restore", at("2024-01-02"), 2), (2, "delete", at("2024-01-01"), 3)], "matter_id int, action string, at timestamp, event_id int")
    state = K.current_state(rows, events, "matter_id")
    assert {r.matter_id for r in K.live(state).collect()} == {1, 3}
    wanted = spark.createDataFrame([("Crest ",), ("Imperial",), ("Other",)], "name string")
    assert {r.name: r.state for r in K.name_check(wanted, state).collect()} == {"Crest ": "deleted", "Imperial": "taken", "Other": "free"}


def test_purge_cascades_and_respects_the_store(spark):
    old = at("2023-01-01")
    files = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", old), (2, 3, "c", None)], "matter_id int, file_id int, filename string, deleted_at timestamp")
    matters = spark.createDataFrame([(1, "M", None), (2, "N", old)], "matter_id int, name string, deleted_at timestamp")
    as_of = F.lit("2024-02-01").cast("timestamp")
    out = K.purge(files, matters, as_of)
    assert {r.file_id for r in out["removed_files"].collect()} == {2, 3} and {r.file_id for r in out["files"].collect()} == {1}
    assert {(r.kind, r.name) for r in out["events"].collect()} == {("file", "b"), ("matter", "N")}
    assert K.purge(files, matters, as_of, store_available=False)["removed_files"].count() == 0


def test_run_states_and_grants(spark):
    rows = [("r1", 1, "running", "10:00:00", 1), ("r1", 1, "done", "10:01:00", 2), ("r1", 1, "running", "10:02:00", 3), ("r2", 2, "running", "10:00:00", 4), ("r3", 3, "queued", "10:09:00", 5)]
    ev = spark.createDataFrame([(a, b, c, at(f"2024-01-01 {d}"), e) for a, b, c, d, e in rows], "run_id string, matter_id long, status string, at timestamp, event_id int")
    states = K.run_states(ev, F.lit("2024-01-01 10:10:00").cast("timestamp"))
    assert {r.run_id: r.status for r in states.collect()} == {"r1": "done", "r2": "interrupted", "r3": "queued"}
    starts = spark.createDataFrame([(3, "n1", at("2024-01-01")), (2, "n2", at("2024-01-02")), (2, "n3", at("2024-01-01"))], "matter_id long, run_id string, at timestamp")
    assert {r.run_id: (r.holder, r.granted) for r in K.grant_runs(starts, states).collect()} == {"n1": ("r3", False), "n2": ("n3", False), "n3": ("n3", True)}


COSTS = "id int, timestamp timestamp, matter_id int, matter_name string, task_id string, model_used string, input_tokens long, output_tokens long, c string, duration_seconds double, was_exhaustive boolean, status string, run_id string"


def ledger(spark):
    rows = [
        (1, at("2024-01-20"), 1, "Imperial Plaza", "draft_memo", "m", 4232, 1847, "0.47", 8.3, False, "completed", "a"),
        (2, at("2024-01-21"), 1, "Imperial Plaza", "timeline", "m", 54542, 16989, "0.6974", 169.5, True, "completed", "b"),
        (3, at("2024-01-22"), 2, "Cresthaven", "summarize", "m", 800, 100, "0.0012", 3.1, False, "failed", "c"),
        (4, at("2024-01-31 23:59:59.500"), 2, "Cresthaven", "timeline", "m", 20000, 5000, "0.31", 64.0, True, "cancelled", "d"),
        (5, at("2023-06-01"), 1, "Imperial Plaza", "find_facts", "m", 0, 0, "0", 0.2, False, "failed", "e"),
        (6, at("2024-01-23"), None, None, "find_facts", None, 0, 0, None, None, False, "completed", None),
    ]
    return spark.createDataFrame(rows, COSTS).withColumn("cost_usd", F.col("c").cast("decimal(18,6)")).drop("c")


def matters(spark, *rows):
    return spark.createDataFrame(list(rows), "matter_id int, name string, deleted_at timestamp")


def test_ledger(spark):
    costs, as_of = ledger(spark), F.lit("2024-02-01").cast("timestamp")
    both = matters(spark, (1, "Imperial Plaza", None), (2, "Cresthaven", at("2024-01-30")))
    t = L.totals(costs).first()
    assert (float(t.total_cost), t.rows, t.unknown_cost) == (1.4786, 6, 1)
    assert L.query_costs(costs, both, as_of, matter_id=1, period="all").count() == 3
    assert L.query_costs(costs, both, as_of, period="30").count() == 5
    assert L.query_costs(costs, both, as_of, date_from="2024-01-31", date_to="2024-01-31").count() == 1
    assert [r.id for r in L.query_costs(costs, both, as_of, period="all", sort="cost").limit(2).collect()] == [2, 1]
    assert [r.id for r in L.query_costs(costs, both, as_of, period="all", sort="x; drop", direction="asc").limit(1).collect()] == [5]
    names = {r.id: r.display_matter for r in L.with_matter(costs, both).collect()}
    assert names[1] == "Imperial Plaza" and names[3] == "Cresthaven (deleted)" and names[6] == "(no matter)"
    purged = {r.id: r.display_matter for r in L.with_matter(costs, matters(spark, (1, "Imperial Plaza", None))).collect()}
    assert purged[3] == "Cresthaven (removed)"
    assert [(r.label, r.n) for r in L.matter_options(costs, both).collect()] == [("Cresthaven (deleted)", 2), ("Imperial Plaza", 3)]


def test_unknown_call_poisons_the_run_only(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    calls = spark.createDataFrame([("a", 1, None, 1, 1, 1.0), ("a", 2, "m", 1, 1, 2.0), ("b", 1, "m", 1, None, 1.0), ("b", 2, "m", 1, 1, None)], "run_id string, seq int, model string, input_tokens long, output_tokens long, cost_usd double")
    got = {r.run_id: (r.calls, r.cost_usd, r.model_used) for r in L.roll_up_runs(runs, calls).collect()}
    assert got == {"a": (2, 3.0, "m"), "b": (2, None, "m"), "c": (0, 0.0, None)}


def test_backfill_is_idempotent(spark):
    rows = [(1, at("2024-01-01"), "matter_query", "timeline", 1, "m", 10, 5, 0.69, 169.5, True, None, "r1", True), (2, at("2024-01-02"), "matter_query", None, 1, "m", 0, 0, 0.0, 1.0, None, None, "r2", True),
            (3, at("2024-01-03"), "ingest", None, None, None, None, None, None, None, None, None, None, False), (4, at("2024-01-04"), "matter_query", None, 1, None, None, None, None, None, None, None, "r3", False)]
    events = spark.createDataFrame(rows, "line_no int, timestamp timestamp, event string, task string, matter_id int, model string, prompt_tokens long, completion_tokens long, cost_usd double, seconds double, exhaustive boolean, cancelled boolean, run_id string, has_cost boolean")
    m, empty = matters(spark, (1, "Imperial Plaza", None)), spark.createDataFrame([], "run_id string")
    first = L.backfill(events, empty, m)
    assert [(r.run_id, r.matter_name, r.source, r.status) for r in first.collect()] == [("r1", "Imperial Plaza", "backfill", "completed")]
    assert L.backfill_counts(events, first).first().asDict() == {"scanned": 4, "inserted": 1, "skipped": 1}
    assert L.backfill(events, first, m).count() == 0


def test_daily_budget(spark):
    df = spark.createDataFrame([(3999,), (4000,), (4899,), (4900,)], "n int")
    assert [r[0] for r in df.select(L.budget_state(F.col("n"))).collect()] == ["ok", "warn", "warn", "stop"]
    assert df.select(L.budget_warning(F.col("n"))).collect()[1][0].startswith("4,000 of CanLII's 5,000")


def test_exhaustive_plan_and_cost(spark):
    counts = [12, 8, 5, 3]
    files = spark.createDataFrame([(1, i, f"f{i}", n * 40, n) for i, n in enumerate(counts)], "run_id int, file_pos int, filename string, tokens long, chunks int")
    assert {r.batch_no for r in E.plan_batches(files, ["run_id"], "file_pos").collect()} == {0}
    tight = E.plan_batches(files, ["run_id"], "file_pos", budget=8_300).orderBy("file_pos").collect()
    assert [(r.filename, r.batch_no, r.over_budget) for r in tight] == [("f0", 0, True), ("f1", 1, True), ("f2", 2, False), ("f3", 3, False)]
    usage = spark.createDataFrame([("anthropic/claude-opus-4.7", 54542, 16989), ("unknown", 1_000_000, 0), ("listed", 1_000_000, 1_000_000)], "model string, i long, o long")
    prices = spark.createDataFrame([("listed", 0.5, 0.25), ("half", 1.0, None)], "id string, prompt_per_million double, completion_per_million double")
    got = {r.model: r.c for r in E.with_prices(usage, prices).withColumn("c", E.cost(F.col("i"), F.col("o"))).collect()}
    assert got["anthropic/claude-opus-4.7"] == pytest.approx(0.6974, abs=0.001) and got["unknown"] == 5.0 and got["listed"] == 0.75
    assert spark.range(1).select(E.billing_tokens(F.lit(100), F.lit("anthropic/x")), E.billing_tokens(F.lit(100), F.lit("x"))).first()[:] == (165, 100)


def test_context_parts_and_blocks(spark):
    rows = [(0, 0, "a.pdf", 1, "t1"), (0, 0, "a.pdf", 2, "t2"), (0, 1, "b.pdf", 1, "t3"), (1, 2, "c.pdf", 1, "big")]
    chunks = spark.createDataFrame(rows, "batch_no int, file_pos int, filename string, chunk_no int, text string")
    batches = spark.createDataFrame([(0, False), (1, True)], "batch_no int, over_budget boolean")
    parts = E.context_parts(chunks, ["batch_no"])
    assert parts.count() == 4
    assert [tuple(r) for r in E.context_blocks(parts, batches, ["batch_no"]).collect()] == [
        (0, "[SOURCE: a.pdf chunk 1]\nt1\n\n[SOURCE: a.pdf chunk 2]\nt2\n\n[SOURCE: b.pdf chunk 1]\nt3")]


def test_run_summary_and_warnings(spark):
    o = spark.createDataFrame([("r", 0, True, False, 10, 5, 1, "a"), ("r", 1, False, False, 5, 5, 1, "b"), ("s", 0, True, False, 3, 1, 1, "c")],
                              "run_id string, batch_no int, ok boolean, cancelled boolean, chunks long, prompt_tokens long, completion_tokens long, filename string")
    s = E.run_summary(o)
    assert {r.run_id: (r.batches, r.failed_batches, r.complete) for r in s.collect()} == {"r": (2, 1, False), "s": (1, 0, True)}
    full = s.withColumn("files", F.lit(2)).withColumn("model", F.lit("m")).withColumn("collapsed", F.when(F.col("run_id") == "s", 4).otherwise(0))
    w = E.run_warnings(full, o, spark.createDataFrame([("r", "z.pdf")], "run_id string, filename string")).orderBy("run_id", "warning_no").collect()
    assert [r.warning.split(" ")[0] for r in w] == ["1", "1", "Exhaustive", "Exhaustive"]
    assert w[2].warning.endswith("No per-file duplicates were collapsed.") and w[3].warning.endswith("4 exact per-file duplicate(s) collapsed.")


def test_bpe_counts_need_an_offline_vocabulary(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("a b c",)], "text string")
    assert E.with_tokens(df).first().tokens == 3


def test_provenance_and_redaction(spark):
    results = spark.createDataFrame([(1, 3), (2, 2)], "result_id int, matter_files int")
    scope = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "result_id int, file_id int")
    hits = spark.createDataFrame([(1, 6, 1), (1, 5, 2), (1, 6, 3)], "result_id int, file_id int, rank int")
    got = {r.result_id: (r.scope_file_ids, r.source_file_ids) for r in K.result_provenance(results, scope, hits).collect()}
    assert got == {1: ([5, 6], [6, 5]), 2: (None, [])}
    f = spark.createDataFrame([(1, 1, "Secret name.PDF", "ingested", "c", "ok"), (1, 2, None, "failed", None, None)], "matter_id int, file_id int, filename string, ingest_status string, collection string, probe string")
    rows = K.redacted_files(f).orderBy("file_id").collect()
    assert (rows[0].ext, rows[0].name_len, rows[0].has_collection, rows[1].name_len) == (".pdf", 15, True, 0) and "filename" not in rows[0]
    assert {(r.kind, r.value): r.files for r in K.diagnostic_counts(K.redacted_files(f)).collect()} == {("status", "ingested"): 1, ("status", "failed"): 1, ("probe", "ok"): 1, ("all", ""): 2}
