"""Shortlist ranking, hygiene, ladder and corpus scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casefile_spark.operators import scans as J
from casefile_spark.operators import shortlist as S

COURTS = [("csc-scc", "SCC", "ca", 1), ("onca", "CA", "on", 2), ("onscdc", "Div", "on", 3), ("onsc", "SC", "on", 4), ("oncj", "CJ", "on", 7), ("oncat", "CAT", "on", 8), ("abkb", "KB", "ab", 10), ("fct", "FC", "ca", 6)]


@pytest.fixture(scope="module")
def curated(spark):
    return spark.createDataFrame(COURTS, "database_id string, name string, jurisdiction string, tier int")


def test_courts(spark, curated):
    cases = spark.createDataFrame([("ONCA",), (" onsm ",), ("zz",), ("csc-scc-al",), ("",)], "database_id string")
    catalogue = spark.createDataFrame([("onsm", "Small", "on"), ("onca", "wrong", "xx")], "database_id string, name string, jurisdiction string")
    got = {r.database_id: (r.court_name, r.jurisdiction, r.tier, r.recognised) for r in S.resolve_courts(cases, curated, catalogue).collect()}
    assert got == {"onca": ("CA", "on", 2, True), "onsm": ("Small", "on", 11, True), "zz": ("ZZ", "", 11, False), "": ("(unknown)", "", 11, False)}


def scored(spark, curated, rows, wanted="Ontario"):
    df = spark.createDataFrame([(1, db, y, f"{y} {db}", 1, 0) for db, y in rows], "request_id int, database_id string, effective_year int, citation string, angles int, best_rank int")
    df = S.resolve_courts(df, curated, spark.createDataFrame([], "database_id string, name string, jurisdiction string"))
    return S.stage_one(df.withColumn("wanted", F.lit(wanted)).withColumn("span", F.lit(30)), 2026)


def test_tier_order_for_ontario(spark, curated):
    rows = [("oncat", 2025), ("csc-scc", 2019), ("abkb", 2025), ("onsc", 2024), ("oncj", 2024), ("onca", 2021), ("onscdc", 2022)]
    got = [r.database_id for r in scored(spark, curated, rows).orderBy(F.desc("score")).collect()]
    assert got == ["csc-scc", "onca", "onscdc", "onsc", "oncj", "oncat", "abkb"]
    old = scored(spark, curated, [("csc-scc", 1997), ("onsc", 2024)]).orderBy(F.desc("score")).first()
    assert old.database_id == "csc-scc"


def test_filters(spark, curated):
    df = scored(spark, curated, [("onca", 1950), ("onca", 2020), ("fct", 2020), ("onca", None)], "Federal").withColumn("w", F.col("wanted"))
    federal = [r.database_id for r in df.filter(S.passes_filters(F.lit(1990), F.col("wanted"))).collect()]
    assert federal == ["fct"]
    everywhere = df.filter(S.passes_filters(F.lit(1990), F.lit("All Canada"))).select("effective_year").collect()
    assert sorted(str(r[0]) for r in everywhere) == ["2020", "2020", "None"]


@pytest.mark.parametrize("keywords, want", [("water escape pipe", 1), ("criminal sentencing", -0.75), (None, 0.0), ("the court and law", 0.0)])
def test_subject_signal(spark, keywords, want):
    df = spark.createDataFrame([(keywords,)], "k string")
    got = df.select(S.subject_signal(F.col("k"), F.lit(""), F.lit("water pipe"))).first()[0]
    assert (got > 0) if want == 1 else got == want


@pytest.mark.parametrize("query, want", [
    ("repair of unit 315 pipe", "repair of unit pipe"), ("damages of $47,500.00 owed", "damages of owed"), ("mail bob@x.ca about leak", "mail about leak"), ("before 2024-03-15 notice", "before notice"),
    ("see https://x.ca/a now", "see now"), ("file CV-123456 claim", "file claim"), ('"Condominium Act, 1998" section 89', '"Condominium Act, 1998" section 89'), ('"unit 315" leak', "unit leak"), (None, ""),
])
def test_scrub(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(S.scrub_query(F.col("q"))).first()[0] == want


def test_usable_queries(spark):
    rows = [(1, i, "a", q) for i, q in enumerate(["duty to repair", "Duty to REPAIR", "short", "second query", "third query $5", "fourth query"])] + [(2, 0, "", "only one query")]
    kept, refused = S.usable_queries(spark.createDataFrame(rows, "request_id int, query_no int, angle string, query string"))
    assert [r["query"] for r in kept.orderBy("query_no").collect()] == ["duty to repair", "second query", "third query", "fourth query"]
    assert [(r.request_id, r.refusal[:6]) for r in refused.collect()] == [(2, "Only 1")]


def test_search_ranks_terms_and_phrases(spark):
    docs = spark.createDataFrame([(0, "duty to repair common elements"), (1, "repair duty common duty elements"), (2, "parking"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, '"common elements" duty'), (2, "parking spaces")], "query_id int, query string")
    got = [(r.query_id, r.doc_id) for r in S.search_corpus(docs, q).orderBy("query_id", "position").collect()]
    assert got == [(1, 0), (1, 1), (2, 2)]


def test_merge_and_rank(spark, curated):
    hits = spark.createDataFrame([(1, "k1", "a", 0, 5, "2020 ONCA 1", "onca"), (1, "k1", "b", 1, 2, "other", "onca"), (1, "k1", "a", 2, 9, "x", "x"), (1, "k2", "b", 1, 0, "2021 ONSC 2", "onsc")],
                                 "request_id int, merge_key string, angle string, query_no int, position int, citation string, database_id string")
    m = {r.merge_key: (r.citation, r.found_by, r.best_rank, r.hits) for r in S.merge_hits(hits, ["citation", "database_id"]).collect()}
    assert m == {"k1": ("2020 ONCA 1", ["a", "b"], 2, 3), "k2": ("2021 ONSC 2", ["b"], 0, 1)}
    df = spark.createDataFrame([("2020 ONCA 1 (CanLII)", "onca", "1"), ("", "ONCA", "C2"), (None, "db", "c")], "c string, d string, i string")
    assert [r[0] for r in df.select(S.merge_key(F.col("c"), F.col("d"), F.col("i"))).collect()] == ["2020 onca 1", "onca/c2", "db/c"]


def test_enrichment_refilters_and_reranks(spark, curated):
    s = scored(spark, curated, [("onca", 2020), ("onsc", 2021), ("onscdc", 2019)]).withColumn("merge_key", F.col("citation"))
    meta = spark.createDataFrame([("2020 onca", dt.date(1980, 1, 1), "water", ""), ("2021 onsc", None, "water pipe", ""), ("2019 onscdc", None, "criminal", "")], "merge_key string, decision_date date, keywords string, topics string")
    req = spark.createDataFrame([(1, 2, "water pipe", 1990)], "request_id int, max_cases int, concepts string, earliest_year int")
    got = S.enrich_and_rank(s, meta, req, 2026).orderBy("rank").collect()
    assert [r.merge_key for r in got] == ["2021 onsc", "2019 onscdc"]
    notes = spark.createDataFrame([(1, "2021 onsc", "model")], "request_id int, merge_key string, note string")
    noted = S.attach_notes(S.enrich_and_rank(s, meta, req, 2026).withColumn("found_by", F.array(F.lit("a"))), notes)
    assert {r.merge_key: r.note_is_fallback for r in noted.collect()} == {"2021 onsc": False, "2019 onscdc": True}
    assert S.note_warnings(noted).first().warning.startswith("1 case(s) below")


def test_widening_ladder(spark):
    def hits(stage, spec):
        return spark.createDataFrame([(r, f"{stage}{r}{i}", ok, stage) for r, ok, n in spec for i in range(n)], "request_id int, merge_key string, passes boolean, stage string")

    req = spark.createDataFrame([(1,), (2,), (3,)], "request_id int")
    out = S.widen(hits("t", [(1, True, 8), (2, True, 7), (3, False, 2)]), hits("b", [(1, True, 1), (2, True, 1), (3, False, 1)]), hits("w", [(1, True, 1), (2, True, 1), (3, True, 1)]), req)
    assert {(r.request_id, r.stage) for r in out.select("request_id", "stage").distinct().collect()} == {(1, "t"), (2, "t"), (2, "b"), (3, "t"), (3, "b"), (3, "w")}


def test_limitation_signals(spark):
    chunks = spark.createDataFrame([(1, 0, "a.pdf", 1, "A 120-day deadline, served within 30 days of 2019."), (1, 1, "b.pdf", 1, "Nothing here in 2025."), (2, 0, "c.pdf", 1, "clean")],
                                   "request_id int, file_pos int, filename string, chunk_no int, text string")
    own = spark.createDataFrame([(1, "the limitation period expired"), (2, "")], "request_id int, text string")
    by_file = J.signals_by_file(chunks, own, 2026)
    got = {}
    for r in by_file.orderBy("file_pos", "kind", "first_at").collect():
        got.setdefault(r.filename, []).append(r.signal.split('"')[1] if r.kind == 0 else r.signal[:39])
    assert got == {"a.pdf": ["deadline", "120-day", "30 days", "within 30 day", "served within", "the matter references the year 2019, more"[:39]], J.OWN_TEXT: ["limitation period", "limitation", "expired"]}
    assert J.union_in_order(by_file).filter("request_id = 1").count() == 9
    reqs = spark.createDataFrame([(1, False), (2, None)], "request_id int, confirmed boolean")
    unread = spark.createDataFrame([(2, 0, "z.pdf")], "request_id int, file_pos int, filename string")
    g = {r.request_id: r for r in J.gate(reqs, by_file, unread).collect()}
    assert (g[1].gate, g[1].signals, g[1].files_with_signals, g[1].warning) == ("refused", 9, 2, None)
    assert g[2].gate == "proceed" and "(z.pdf); they were NOT scanned" in g[2].warning
    confirmed = J.gate(reqs.withColumn("confirmed", F.lit(True)), by_file, unread)
    assert {r.gate for r in confirmed.collect()} == {"proceed"}


def test_hallmarks(spark):
    df = spark.createDataFrame([(1, "STATEMENT OF CLAIM"), (1, "court file no. 5"), (2, "the defendant")], "f int, text string")
    assert {r.f: (r.hallmarks, r.looks_like_pleading) for r in J.hallmarks(df, ["f"]).collect()} == {1: (2, True), 2: (1, False)}


def test_year_and_funnel(spark):
    df = spark.createDataFrame([("2020 ONCA 1",), (" 1799 X 1",), ("2030 X",), ("Re 2020",), (None,)], "c string")
    assert [r[0] for r in df.select(S.citation_year(F.col("c"), 2026)).collect()] == [2020, None, None, None, None]


def test_queries_are_scrubbed_once(spark):
    """The filter on length and the keys read the scrubbed query; none of them scrubs it again."""
    rows = spark.createDataFrame([(1, i, "", q) for i, q in enumerate(["  plain   words here ", "see a@b.co and 12345 of 1999", None, "pay $1,000.50 now please", 'odd "quote mark', "PLAIN words here"])], "request_id int, query_no int, angle string, query string")
    kept, _ = S.usable_queries(rows)
    assert sorted(r.query for r in kept.collect()) == ["odd quote mark", "pay now please", "plain words here", "see and of 1999"]
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") >= 1


def test_widening_deals_hits_by_rows(spark, monkeypatch):
    """Tasks follow the number of hits, not the session; null keys count as none and requests that come twice give their hits twice."""
    def hits(spec):
        return spark.createDataFrame(spec, "request_id int, merge_key string, passes boolean")

    targeted = hits([(1, f"k{i % 7}", True) for i in range(20)] + [(2, None, True), (2, "x", None), (3, "a", False), (4, "a", True), (None, "n", True), (9, "z", True)])
    broadened = hits([(1, "b", True), (2, None, True), (3, "b", False), (3, "b", True), (4, "b", True)])
    browsed = hits([(1, "w", True), (2, "w", False), (3, "w", True), (5, "w", True), (None, "w", True)])
    requests = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (5,), (None,)], "request_id int")
    monkeypatch.setattr(S, "WIDEN_ROWS", 5)
    out = S.widen(targeted, broadened, browsed, requests, rows=35)
    got = {(r.request_id, r.broadened, r.used_browse): r["n"] for r in out.groupBy("request_id", "broadened", "used_browse").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, True, False): 21, (2, True, True): 4, (3, True, False): 3, (4, True, False): 4, (5, True, True): 1}
    assert out.columns == ["request_id", "merge_key", "passes", "broadened", "used_browse"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [request_id#") >= 4
    assert ", 8" in out._jdf.queryExecution().optimizedPlan().toString()
