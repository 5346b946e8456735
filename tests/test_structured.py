"""Completions to tables on golden payloads."""

import json

import pytest
from pyspark.sql import functions as F

from casefile_spark.operators import structured as G

TIMELINE = {"events": [
    {"date": "15 March 2024", "date_iso": None, "event": "Notice", "source": "a p.1", "significance": "x"},
    {"date": "March 2024", "date_iso": None, "event": "Meeting"}, {"date": "2024-05-01", "event": "Reply", "source": "a p.2"}]}
ENTITIES = {"categories": [{"name": "People", "rows": [{"entity": "Ann", "count": 2, "source": "a"}, {"entity": "Bo"}]}, {"name": "Addresses", "rows": [], "note": "None found."}]}
COMPARISON = {"files": ["a.pdf", "b.pdf"], "rows": [{"attribute": "Fee", "cells": ["5"]}, {"attribute": "Term", "cells": ["1y", "Not present in this document", "extra"]}]}
TABLE = "## Found\n\n| Date | Event |\n|---|---|\n| 1 | a |\n| 2 | b | c |\n\ntext | not a table\n"


def completion(payload, body="Answer"):
    return f"{body}\n\n```json\n{{\"example\": 1}}\n```\n\n```json\n{payload if isinstance(payload, str) else json.dumps(payload)}\n```\nend"


@pytest.fixture(scope="module")
def split(spark):
    rows = [
        (1, "timeline", completion(TIMELINE, TABLE)), (2, "find_entities", completion(ENTITIES)), (3, "compare_clauses", completion(COMPARISON)), (4, "timeline", completion('{"events": [}', TABLE)),
        (5, "timeline", "no block"), (6, "draft_memo", " prose ```json\n{}\n``` "), (7, "timeline", completion('{"events": [{"date": "x"}]}')), (8, "find_entities", completion('{"other": 1}')),
        (9, "timeline", completion('{"events": []} trailing')),
    ]
    return G.split_block(spark.createDataFrame(rows, "result_id int, task string, answer string"))


def test_last_block_is_taken_and_stripped(split):
    got = {r.result_id: r for r in split.collect()}
    assert json.loads(got[2].payload) == ENTITIES
    assert got[2].answer_text == 'Answer\n\n```json\n{"example": 1}\n```\n\n\nend'
    assert got[4].payload == '{"events": [}' and "events" not in got[4].answer_text
    assert got[5].payload is None and got[6].payload is None and got[6].answer_text == "prose ```json\n{}\n```"


def test_timeline(split):
    rows, bad = G.parse_timeline(split)
    assert [(r.date, r.date_iso, r.event, r.source) for r in rows.orderBy("row_no").collect()] == [
        ("15 March 2024", "2024-03-15", "Notice", "a p.1"), ("March 2024", None, "Meeting", ""), ("2024-05-01", "2024-05-01", "Reply", "a p.2")]
    assert {r.result_id: r.reason for r in bad.collect()} == {4: G.NO_BLOCK, 5: G.NO_BLOCK, 7: G.NOT_VALID, 9: G.NO_BLOCK}


def test_entities_keep_empty_categories(split):
    rows, bad = G.parse_entities(split)
    assert [(r.category, r.entity, r["count"], r.note) for r in rows.orderBy("category_no", "row_no").collect()] == [
        ("People", "Ann", 2, ""), ("People", "Bo", None, ""), ("Addresses", None, None, "None found.")]
    assert {r.result_id: r.reason for r in bad.collect()} == {8: G.NOT_VALID}
    assert [(r.category, r.entities, r.mentions, r.note) for r in G.entity_rollup(rows).orderBy("category_no").collect()] == [("People", 2, 2, ""), ("Addresses", 0, 0, "None found.")]


def test_comparison_is_squared_off(split):
    cells, bad = G.parse_comparison(split)
    assert {(r.attribute, r.file): r.cell for r in cells.collect()} == {("Fee", "a.pdf"): "5", ("Fee", "b.pdf"): "", ("Term", "a.pdf"): "1y", ("Term", "b.pdf"): "Not present in this document"}
    assert bad.count() == 0
    assert {r.file: r.absent for r in G.absent_files(cells, ["result_id", "file"]).collect()} == {"a.pdf": False, "b.pdf": True}
    wide = {r.attribute: (r["a.pdf"], r["b.pdf"]) for r in G.comparison_pivot(cells, ["a.pdf", "b.pdf"]).collect()}
    assert wide["Fee"] == ("5", "")


@pytest.mark.parametrize("value, want", [
    ("2024-03-05", "2024-03-05"), ("5 March 2024", "2024-03-05"), ("March  5, 2024", "2024-03-05"), ("5 Mar 2024", "2024-03-05"), ("Mar 5, 2024", "2024-03-05"), ("5 MARCH 2024", "2024-03-05"),
    ("March 2024", None), ("on or about 3 May 2024", None), ("circa 2024-01-01", None), ("2024-02-30", None), ("", None), (None, None), ("31/12/2024", None), ("May 1, 2024", "2024-05-01"),
])
def test_complete_dates(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(G.complete_date(F.col("v"))).first()[0] == want


def test_markdown_rows_and_reconcile(spark, split):
    rows = G.markdown_rows(G.answer_lines(split))
    assert {r.result_id: r.markdown_rows for r in rows.filter("markdown_rows > 0").collect()} == {1: 2, 4: 2}
    s = spark.createDataFrame([(1, "timeline", 3), (2, "entity", 5), (4, "timeline", 2)], "result_id int, kind string, structured_rows long")
    got = {r.result_id: r.warning for r in G.reconcile(s, rows).collect()}
    assert got[1].startswith("Export note: the timeline table on screen has 2 row(s) but the structured export data has 3.") and got[2] is None and got[4] is None


def test_markdown_rows_of_a_long_table(spark):
    md = "| a |b|\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(100)) + "\n\ntext"
    assert G.markdown_rows(G.answer_lines(spark.createDataFrame([(1, md), (2, "")], "result_id int, answer_text string"))).orderBy("result_id").collect() == [(1, 100), (2, 0)]


def test_markdown_tables(spark):
    md = "# A\n| h1 | h2 |\n| --- | :-: |\n| x | y |\n| z |\ntext\n## B ##\nlead\n|p|q|\n|-|-|\n| only header above |\n| a | b | c |\n\n| no | rule |\n| x | y |"
    tables, rows = G.markdown_tables(G.answer_lines(spark.createDataFrame([(1, md)], "result_id int, answer_text string")))
    assert [(r.title, r.headers, r.rows, r.note[:8]) for r in tables.orderBy("table_no").collect()] == [("A", ["h1", "h2"], 2, "1 row(s)"), ("B", ["p", "q"], 2, "2 row(s)")]
    assert [r["cells"] for r in rows.orderBy("table_no", "row_no").collect()] == [["x", "y"], ["z", ""], ["only header above", ""], ["a", "b"]]


def test_export_prefers_structured_rows(split):
    got = G.export_tables(split)
    kinds = {(r.result_id, r.table_title, r.structured) for r in got.collect()}
    assert {(1, "Timeline", True), (2, "People", True), (2, "Addresses", True), (3, "Clause comparison", True), (4, "Found", False)} <= kinds
    head = got.filter("result_id = 3").first().headers
    assert head == ["Attribute", "a.pdf", "b.pdf"]
    assert [r.date_value for r in got.filter("result_id = 1").orderBy("row_no").collect()] == ["2024-03-15", None, "2024-05-01"]


def test_collapse_is_exact_per_file_and_idempotent(spark):
    rows = [("f", 1, "2024-01-01", "Notice served on tenant", "a p.1"), ("f", 2, "2024-01-01", "notice  served on tenant.", "a p.2"), ("f", 3, "2024-01-01", "Notice served on landlord", "a p.3"),
            ("g", 1, "2024-01-01", "Notice served on tenant", "b p.1"), ("f", 4, "2024-01-01", "NOTICE served on tenant;", "a p.1")]
    df = spark.createDataFrame(rows, "file string, pos int, date string, event string, source string")
    once = G.collapse_within(df, ["file"], ["date", "event"], "pos", "source")
    got = {(r.file, r.pos): (r.event, r.source, r.repeats) for r in once.collect()}
    assert got == {("f", 1): ("Notice served on tenant", "a p.1; a p.2", 2), ("f", 3): ("Notice served on landlord", "a p.3", 0), ("g", 1): ("Notice served on tenant", "b p.1", 0)}
    again = G.collapse_within(once.drop("repeats"), ["file"], ["date", "event"], "pos", "source")
    assert {(r.file, r.pos): (r.source, r.repeats) for r in again.collect()} == {k: (v[1], 0) for k, v in got.items()}
    assert {r.file: r.rows_collapsed for r in G.collapse_count(once, ["file"]).collect()} == {"f": 2, "g": 0}
