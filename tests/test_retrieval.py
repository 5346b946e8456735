"""Retrieval on orthogonal unit vectors, coverage, depth, prompts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casefile_spark.operators import prompts as P
from casefile_spark.operators import retrieval as R
from casefile_spark.operators import vectorise as V


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("a", 0, 0, "a0", [1.0, 0.0, 0.0], "A.pdf", "p.1", "a-near"), ("a", 0, 1, "a1", [0.0, 1.0, 0.0], "A.pdf", "p.2", "a-far"),
        ("b", 1, 0, "b0", [0.94, 0.34, 0.0], "B.pdf", "p.5 (OCR)", "b-mid"), ("b", 1, 1, "b1", [0.0, 0.0, 1.0], "B.pdf", "from Ann Example, 2024-05-11", "b-far"),
        ("b", 1, 2, "b2", [1.0, 0.0], "B.pdf", "p.9", "wrong size"),
    ]
    return spark.createDataFrame(rows, "collection string, collection_pos int, chunk_no int, chunk_key string, embedding array<float>, source string, locator string, text string")


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(1, 3, [1.0, 0.0, 0.0])], "query_id long, k int, embedding array<double>")


def requested(spark, names):
    return spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "query_id long, collection string, collection_pos int")


def test_scatter_gather_order_and_scores(chunks, query):
    got = R.with_passages(R.search_across(chunks, query), chunks).orderBy("rank").collect()
    assert [r.text for r in got] == ["a-near", "b-mid", "a-far"]
    assert got[0].score == pytest.approx(1.0) and got[0].score > got[1].score > got[2].score
    assert got[1].locator == "p.5 (OCR)"


def test_one_collection_returns_what_it_has(chunks, query):
    assert [r.chunk_key for r in R.search_one(chunks, "b", query).orderBy("rank").collect()] == ["b0", "b1"]
    assert R.search_one(chunks, "none", query).count() == 0


def test_per_file_is_total_and_ordered(spark, chunks, query):
    got = R.grouped_hits(R.search_per_file(chunks, query, requested(spark, ["b", "empty", "a"]))).orderBy("collection_pos").collect()
    assert [(r.collection, [h.chunk_key for h in r.hits]) for r in got] == [("b", ["b0", "b1"]), ("empty", []), ("a", ["a0", "a1"])]


def test_coverage_names_what_was_skipped(spark, chunks):
    report = R.coverage_report(requested(spark, ["b", "gone", "a"]), chunks)
    row = R.require_coverage(report).first()
    assert (row.attempted, row.answered, row.skipped) == (3, 2, ["gone"])
    manifest = spark.createDataFrame([("gone", "Gone.pdf")], "collection string, filename string")
    assert R.partial_warning(report, manifest).first().warning.startswith("Retrieved from 2 of 3 files. 1 file(s) could not be read from the search index and did not contribute to this answer: Gone.pdf.")


def test_nothing_readable_is_an_error(spark, chunks):
    report = R.coverage_report(requested(spark, ["x", "y"]), chunks)
    with pytest.raises(PySparkException, match="None of the 2 file"):
        R.require_coverage(report).collect()


@pytest.mark.parametrize("n, depth", [(1, None), (2, 6), (6, 6), (10, 4), (20, 3), (21, None)])
def test_compare_depth(spark, n, depth):
    plan = R.compare_plan(spark.createDataFrame([(1, n, 6, None)], "query_id int, n_files int, base_depth int, override int")).first()
    assert plan.depth == depth and (plan.refusal is None) == (depth is not None)


def test_compare_override_bypasses_the_budget(spark):
    plan = R.compare_plan(spark.createDataFrame([(1, 10, 6, 9)], "query_id int, n_files int, base_depth int, override int")).first()
    assert plan.depth == 9 and plan.over_budget


def test_answer_depth(spark):
    df = spark.createDataFrame([(5, "Detailed"), (None, "Detailed"), (None, "Concise"), (None, None)], "o int, d string")
    assert [r[0] for r in df.select(R.answer_depth(F.col("o"), F.col("d"), F.lit(14))).collect()] == [5, 28, 14, 14]


def test_citations_and_contributors(spark):
    rows = [(1, 2, "B.pdf", "p.1", " x\ny "), (1, 1, "A.pdf", "p.1", "z" * 200), (1, 3, "A.pdf", "p.1", "again"), (1, 4, "A.pdf", "p.2", "w")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source string, locator string, text string")
    got = {(r.source, r.locator): (r["rank"], r.snippet) for r in R.citation_list(hits).collect()}
    assert got == {("B.pdf", "p.1"): (2, "x y"), ("A.pdf", "p.1"): (1, "z" * 160 + "..."), ("A.pdf", "p.2"): (4, "w")}
    assert [(r.source, r.passages) for r in R.contributors(hits, ["source"]).orderBy("position").collect()] == [("A.pdf", 3), ("B.pdf", 1)]


def test_parity(spark, chunks):
    good = chunks.filter("chunk_key != 'b2'")
    assert all(r.parity for r in R.vector_parity(good, good, ["collection"]).collect())
    bad = good.withColumn("embedding", F.reverse("embedding"))
    assert not all(r.parity for r in R.vector_parity(good, bad, ["collection"]).collect())


def test_text_vectors_find_the_text(spark, tmp_path):
    docs = spark.createDataFrame([(0, "water leak in the pipe"), (1, "parking dispute with a neighbour"), (2, None)], "i int, text string")
    fitted, folder = V.fit_vectoriser(docs, dim=256), str(tmp_path / "model")
    V.save(fitted, spark, folder)
    model = V.load(spark, folder)
    assert model == fitted
    c = V.vectorise(model, docs).select(F.lit("c").alias("collection"), F.lit(0).alias("collection_pos"), F.col("i").alias("chunk_no"), F.col("i").alias("chunk_key"), "embedding")
    q = V.vectorise(model, spark.createDataFrame([("the leak",)], "text string")).select(F.lit(1).alias("query_id"), F.lit(1).alias("k"), "embedding")
    assert R.search_across(c, q).first().chunk_key == "0"


def test_context_message(spark, chunks, query):
    hits = R.with_passages(R.search_across(chunks, query.withColumn("k", F.lit(2))), chunks)
    req = spark.createDataFrame([(1, "Task: T\nTopic: x"), (2, "Task: U")], "query_id long, request_text string")
    got = {r.query_id: r.message for r in P.context_message(hits, req).collect()}
    assert got[1] == "CONTEXT:\n\n[SOURCE: A.pdf p.1]\na-near\n\n[SOURCE: B.pdf p.5 (OCR)]\nb-mid\n\nREQUEST:\nTask: T\nTopic: x"
    assert got[2] == "CONTEXT:\n\nREQUEST:\nTask: U"


def test_comparison_message_lists_empty_files(spark, chunks, query):
    hits = R.with_passages(R.search_per_file(chunks, query.withColumn("k", F.lit(1)), requested(spark, ["b", "empty", "a"])), chunks)
    hits = hits.withColumn("source", F.concat(F.upper("collection"), F.lit(".pdf")))
    req = spark.createDataFrame([(1, "Task: Compare")], "query_id long, request_text string")
    text = P.comparison_message(hits, req).first().message
    assert "\n1. B.pdf - 1 passage(s) retrieved\n2. EMPTY.pdf - NO passages retrieved\n3. A.pdf - 1 passage(s) retrieved\n\nCONTEXT:\n\n" in text
    assert "=== DOCUMENT: EMPTY.pdf ===\n\n(no passages relevant to the requested clause were retrieved from this document)\n\n=== DOCUMENT: A.pdf" in text
    assert text.endswith("\n\nREQUEST:\nTask: Compare")


INPUTS = "id int, inputs array<struct<name string, label string, required boolean, control boolean, values array<string>>>"


def test_inputs(spark):
    rows = [
        (1, [("q", "Question", True, False, ["who"]), ("k", "Kinds", False, False, ["a", "b"]), ("d", "Depth", True, True, ["Detailed"])]),
        (2, [("q", "Question", True, False, [""]), ("k", "Kinds", True, False, []), ("d", "Depth", True, True, None)]),
    ]
    df = spark.createDataFrame(rows, INPUTS)
    got = df.select(
        P.retrieval_text(F.lit("seed"), F.lit("L"), F.col("inputs")).alias("a"), P.retrieval_text(F.lit(""), F.lit("L"), F.col("inputs")).alias("b"),
        P.request_section(F.lit("L"), F.col("inputs")).alias("c"), P.missing_required(F.col("inputs")).alias("d"),
    ).collect()
    assert tuple(got[0]) == ("seed who a b", "who a b", "Task: L\nQuestion: who\nKinds: a, b", [])
    assert tuple(got[1]) == ("seed", "L", "Task: L", ["Question", "Kinds", "Depth"])


def test_clamp_and_pleading_rules(spark):
    df = spark.createDataFrame([("7",), ("99",), (" 0 ",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(P.clamp_int(F.col("v"), 15, 1, 25)).collect()] == [7, 25, 1, 15, 15]
    soc, sod = P.PLAINTIFF_TYPES[0], P.DEFENDANT_TYPES[0]
    df = spark.createDataFrame([(soc, "x", None), (soc, "", None), (sod, None, True), (sod, "x", None), (None, "x", True)], "t string, p string, o boolean")
    got = [(r[0], r[1]) for r in df.select(P.pleading_errors(F.col("t"), F.col("p"), F.col("o")), P.party_role(F.col("t"))).collect()]
    assert got == [([], "Plaintiff"), ([P.NEED_PARTICULARS], "Plaintiff"), ([], "Defendant"), ([P.NEED_OPPOSING], "Defendant"), ([P.PICK_TYPE], "Plaintiff")]


def test_availability(spark):
    df = spark.createDataFrame([("compare_clauses", 1), ("compare_clauses", 2), ("suggest_cases", 0), ("summarize", None), ("compare_clauses", None)], "t string, n int")
    got = [r[0] for r in df.select(P.task_refusal(F.col("t"), F.lit("X"), F.col("n"))).collect()]
    assert got == ["X needs at least 2 ingested files in this matter; this matter has 1.", None, "X needs at least 1 ingested files in this matter; this matter has 0.", None,
                   "X runs across the documents in a matter and is not available for a single uploaded file."]


def test_scope(spark):
    files = spark.createDataFrame([(1, 10, "a.pdf", True, "Ready"), (2, 10, "b.pdf", False, "Failed"), (3, 11, "c.pdf", True, "Ready"), (4, 10, "d.pdf", True, "Ready")],
                                  "file_id long, matter_id long, filename string, queryable boolean, label string")
    reqs = spark.createDataFrame([(1, 10, "t", "all"), (2, 10, "t", "selected"), (3, 10, "t", "selected"), (4, 10, "t", "single"), (5, 10, "t", "single"), (6, 10, "compare_clauses", "single"), (7, 10, "t", "selected"), (8, 10, "t", None), (9, 10, "t", "single")],
                                 "request_id long, matter_id long, task string, scope_mode string")
    picks = spark.createDataFrame([(3, 1, "4"), (3, 2, "4"), (4, 1, "2"), (5, 1, ""), (6, 1, "1"), (7, 1, "1"), (7, 2, "3"), (7, 3, "zz"), (9, 1, "1")], "request_id long, pick_no int, file_id string")
    verdict, chosen = P.resolve_scope(reqs, picks, files)
    refusal = {r.request_id: r.refusal for r in verdict.collect()}
    assert refusal == {1: None, 2: None, 3: None, 4: "b.pdf cannot be searched (status: Failed). Re-process it from the file list above.", 5: P.CHOOSE_FILE, 6: None,
                       7: "File 3 does not belong to matter 10.", 8: None, 9: None}
    got = {}
    for r in chosen.collect():
        got.setdefault(r.request_id, set()).add(r.file_id)
    assert got == {1: {1, 4}, 2: {1, 4}, 3: {4}, 6: {1, 4}, 8: {1, 4}, 9: {1}}


def test_whole_matters_are_not_repeated_for_each_request(spark):
    files = spark.range(200).select(F.col("id").alias("file_id"), (F.col("id") % 2).alias("matter_id"), F.lit("a").alias("filename"), (F.col("id") > 9).alias("queryable"), F.lit("x").alias("label"))
    reqs = spark.range(100).select(F.col("id").alias("request_id"), (F.col("id") % 3).alias("matter_id"), F.lit("t").alias("task"), F.when(F.col("id") < 90, "all").otherwise("selected").alias("scope_mode"))
    picks = spark.createDataFrame([(90, 1, "20"), (91, 1, "x"), (91, 2, "21"), (93, 1, "3"), (94, 1, "2"), (94, 2, "12"), (96, 1, "30"), (96, 2, "30"), (96, 3, "32")], "request_id long, pick_no int, file_id string")
    verdict, chosen = P.resolve_scope(reqs, picks, files)
    _, whole, named = P.scope_parts(reqs, picks, files)
    assert whole.count() + named.count() < 100 and chosen.count() > 5000
    want = chosen.groupBy("request_id").agg(F.count("*").alias("files"), F.sum("file_id").alias("id_sum"))
    assert sorted(map(tuple, P.scope_totals(whole, named, files).collect())) == sorted(map(tuple, want.collect()))
    refusal = {r.request_id: r.refusal for r in verdict.filter("refusal IS NOT NULL").collect()}
    assert refusal == {91: P.BAD_SELECTION, 93: "File 3 does not belong to matter 0.", 94: "File 2 does not belong to matter 1."}
    assert "min_by(_fault" in (plan := verdict._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


def test_system_prompt_parts(spark):
    templates = spark.createDataFrame([("timeline", " body ", None), ("draft", "b", {"k": "v"})], "task string, body string, variants map<string,string>")
    reqs = spark.createDataFrame([(1, "timeline", None, False, False, "Detailed", None), (2, "draft", "k", True, True, None, None), (3, "draft", "zz", False, False, None, None), (4, "timeline", None, True, False, "Exhaustive (preview)", None), (5, "nope", None, False, False, None, None)],
                                 "request_id int, task string, variant_key string, cross_document boolean, authority boolean, detail_level string, mode string")
    texts = {"preamble": "P", "matter_preamble": "MP", "matter_note": "N", "authority": "A", "detailed": "D", "exhaustive_timeline": "X"}
    got = {r.request_id: (r.system_prompt, r.error) for r in P.system_prompts(reqs, templates, texts).collect()}
    assert got[1] == ("P\n\nbody\n\nD", None) and got[2] == ("MP\n\nN\n\nb\n\nv\n\nA", None) and got[4] == ("MP\n\nN\n\nbody\n\nX", None)
    assert got[3][0] is None and "valid pleading_type" in got[3][1] and got[5] == (None, "Unknown task: nope")


def test_top_k_limit_runs_before_the_shuffle(chunks, query):
    df = R.search_across(chunks, query)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_collections_of_another_size_are_skipped_by_name(spark, chunks):
    odd = chunks.withColumn("embedding", F.when(F.col("collection") == "b", F.slice("embedding", 1, 2)).otherwise(F.col("embedding")))
    report = R.coverage_report(requested(spark, ["b", "a"]), R.readable(odd, 3)).first()
    assert (report.attempted, report.answered, report.skipped) == (2, 1, ["b"])


def test_queries_of_two_sizes_fail(spark, chunks):
    mixed = spark.createDataFrame([(1, 3, [1.0, 0.0, 0.0]), (2, 3, [1.0, 0.0])], "query_id long, k int, embedding array<double>")
    with pytest.raises(ValueError, match="differ in size"):
        R.search_across(chunks, mixed)


def test_only_requested_pairs_are_scored(spark, chunks):
    two = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0]), (2, 2, [0.0, 1.0, 0.0])], "query_id long, k int, embedding array<double>")
    asked = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "query_id long, collection string, collection_pos int")
    got = R.search_per_file(chunks, two, asked).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.collection, r.chunk_key) for r in got] == [(1, "a", "a0"), (2, "b", "b0"), (2, "b", "b1")]
