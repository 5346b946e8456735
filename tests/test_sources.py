"""Sources and sinks on small fixtures."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casefile_spark.functions import membership
from casefile_spark.sources import catalogues, cells, eventlog, files, messages, pages, sinks
from casefile_spark.sources.chunk_index import ChunkIndex, IndexChanged


def test_scan_takes_known_suffixes_and_hashes_content(spark, tmp_path):
    for name, body in (("a.pdf", b"one"), ("b.DOCX", b"two"), ("c.txt", b"no"), ("sub/d.eml", b"one")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(body)
    got = {r.filename: r for r in files.scan_corpus(spark, str(tmp_path), 7).collect()}
    sha = hashlib.sha256(b"one").hexdigest()
    assert set(got) == {"a.pdf", "b.DOCX", "d.eml"}
    assert got["a.pdf"].content_sha256 == got["d.eml"].content_sha256 == sha
    assert got["a.pdf"].collection == f"m7-{sha[:16]}" and got["b.DOCX"].file_type == "docx"
    assert files.scan_corpus(spark, str(tmp_path)).first().collection.startswith("day1-")


def test_page_triage(spark):
    rows = [(1, 1, " native ", "x", 0.1), (1, 2, " ", "scan", 0.1), (1, 3, None, "", 0.99), (1, 4, "", None, 0.5), (1, 5, None, None, None)]
    t = pages.triage_pages(spark.createDataFrame(rows, "file_id int, page_no int, native_text string, ocr_text string, near_white double"))
    assert [(r.page_no, r.status) for r in t.orderBy("page_no").collect()] == [(1, "native"), (2, "ocr"), (3, "blank"), (4, "unreadable"), (5, "unreadable")]
    assert [(r.page_no, r.text, r.is_ocr) for r in pages.readable_pages(t).orderBy("page_no").collect()] == [(1, "native", False), (2, "scan", True)]
    report = pages.page_report(t).first()
    assert (report.ocr_pages, report.unreadable_pages) == ([2], [4, 5])


def test_message_bodies_and_attachments(spark):
    rows = [
        (1, 0, "text/html", None, None, "<p>html</p>"), (1, 1, "text/plain", None, None, " plain "), (1, 2, "text/plain", "attachment", None, "bytes"),
        (2, 0, "text/html", None, None, "<b>a</b>&amp;b"), (2, 1, "application/pdf", "attachment", "x.pdf", ""), (3, 0, "image/png", None, None, ""),
    ]
    parts = spark.createDataFrame(rows, "msg_id int, part_no int, content_type string, disposition string, filename string, content string")
    assert {r.msg_id: r.body for r in messages.message_bodies(parts).collect()} == {1: "plain", 2: "a&b", 3: ""}
    assert {r.msg_id: r.attachments for r in messages.attachment_names(parts).collect()} == {1: ["(unnamed attachment)"], 2: ["x.pdf"]}


def test_message_headers(spark):
    rows = [
        (1, {"from": "Ann Example <k@x.ca>", "date": "Sat, 11 May 2024 23:30:00 -0400", "subject": "s"}),
        (2, {"from": '"Doe, Jane" <j@x.ca>', "date": "11 May 2024 08:00 GMT (UTC)"}),
        (3, {"from": "plain@x.ca", "date": "someday"}),
        (4, {"from": "<only@x.ca>"}),
        (5, {}),
    ]
    got = {r.msg_id: (r.sender_name, r.date_iso, r.locator) for r in messages.message_headers(
        spark.createDataFrame(rows, "msg_id int, headers map<string,string>")).collect()}
    assert got[1] == ("Ann Example", "2024-05-11", "from Ann Example, 2024-05-11")
    assert got[2] == ("Doe, Jane", "2024-05-11", "from Doe, Jane, 2024-05-11")
    assert got[3] == ("plain@x.ca", "", "from plain@x.ca")
    assert got[4][0] == "only@x.ca" and got[5] == ("", "", "from ")


def test_cell_rendering(spark):
    rows = [
        ("timestamp", None, None, dt.datetime(2025, 1, 31)), ("timestamp", None, None, dt.datetime(2025, 1, 31, 9, 5)),
        ("number", None, 3.0, None), ("number", None, 2.5, None), ("number", None, 12345678.25, None), ("number", None, 0.0005, None),
        ("text", "  x ", None, None), ("text", None, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, t string, n double, ts timestamp")
    got = [r[0] for r in df.select(cells.render_cell(F.col("k"), F.col("t"), F.col("n"), F.col("ts"))).collect()]
    assert got == ["2025-01-31", "2025-01-31 09:05:00", "3", "2.5", "12345678.25", "0.0005", "x", ""]


def test_event_log_counts_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "a", "n": 1}\nnot json\n\n{"event": "b"}\n')
    got = eventlog.read_events(spark, str(tmp_path), "event string, n int")
    assert {(r.event, r.n, r.malformed) for r in got.collect()} == {("a", 1, False), (None, None, True), ("b", None, False)}
    assert eventlog.log_counts(got).first().asDict() == {"scanned": 2, "malformed": 1}


def test_ledger_csv(spark, tmp_path):
    rows = [(dt.datetime(2024, 3, 1, 2, 0), 1, "M", "t", "m", True, "completed", 5, 6, "0.697449", 169.5), (dt.datetime(2024, 3, 1, 12, 0), None, None, "t", None, False, "failed", 0, 0, None, None)]
    df = spark.createDataFrame(
        rows, "timestamp timestamp, matter_id int, display_matter string, task_id string, model_used string, was_exhaustive boolean, "
        "status string, input_tokens long, output_tokens long, c string, duration_seconds double",
    ).withColumn("cost_usd", F.col("c").cast("decimal(18,6)"))
    got = [r.asDict() for r in sinks.ledger_csv_rows(df, "America/Toronto").orderBy("timestamp_utc").collect()]
    assert got[0]["date_local"] == "2024-02-29" and got[0]["cost_usd"] == "0.6974" and got[0]["duration_seconds"] == "169.5"
    assert got[1]["matter_id"] == got[1]["cost_usd"] == got[1]["duration_seconds"] == "" and got[1]["exhaustive"] == "false"
    sinks.write_ledger_csv(df, str(tmp_path / "out"))
    head = next(p for p in (tmp_path / "out").glob("*.csv")).read_text(encoding="utf-8").splitlines()[0]
    assert head == "﻿" + ",".join(sinks.CSV_COLUMNS)


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "matter_id long, file_id long, chunk_index int, text string")


def test_chunk_index_replaces_whole_files_only(spark, tmp_path):
    folder = str(tmp_path / "index")
    sinks.replace_files(folder, _chunks(spark, [(1, f, i, f"old {f} {i}") for f in range(6) for i in range(3)]), buckets=2)
    gone = spark.createDataFrame([(1, 5)], "matter_id long, file_id long")
    sinks.replace_files(folder, _chunks(spark, [(1, 2, 0, "new")]), gone=gone, buckets=2)
    got = {(r.file_id, r.chunk_index): r.text for r in sinks.read_chunks(spark, folder).collect()}
    assert got == {**{(f, i): f"old {f} {i}" for f in (0, 1, 3, 4) for i in range(3)}, (2, 0): "new"}


def test_a_bucket_that_lost_its_last_file_is_empty(spark, tmp_path):
    folder = str(tmp_path / "index")
    sinks.replace_files(folder, _chunks(spark, [(1, 7, 0, "only file")]), buckets=1)
    gone = spark.createDataFrame([(1, 7)], "matter_id long, file_id long")
    for _ in range(2):
        sinks.replace_files(folder, _chunks(spark, []), gone=gone, buckets=1)
        assert sinks.read_chunks(spark, folder).count() == 0
    sinks.replace_files(folder, _chunks(spark, [(1, 8, 0, "next")]), buckets=1)
    assert [r.text for r in sinks.read_chunks(spark, folder).collect()] == ["next"]


def test_a_second_scan_reads_new_files_and_quarantines_bad_ones(spark, tmp_path):
    import os

    folder = tmp_path / "c"
    folder.mkdir()
    for name, body in (("a.pdf", b"one"), ("big.docx", b"x" * 500), ("note.txt", b"no")):
        (folder / name).write_bytes(body)
    listed = files.list_corpus(spark, str(folder))
    good, bad = files.scan_files(spark, str(folder), listed, max_bytes=100)
    assert [r.filename for r in good.collect()] == ["a.pdf"]
    assert {r.filename: r.reason for r in bad.collect()} == {"big.docx": "too large", "note.txt": "suffix"}
    seen = spark.createDataFrame(listed.collect(), files.LISTED)
    (folder / "b.eml").write_bytes(b"two")
    (folder / "a.pdf").write_bytes(b"one, changed")
    os.utime(folder / "b.eml", (1_000_000_000, 1_000_000_000))  # copied with an old time
    fresh = files.new_files(files.list_corpus(spark, str(folder)), seen)
    assert sorted(r.filename for r in fresh.collect()) == ["a.pdf", "b.eml"]
    good, bad = files.scan_files(spark, str(folder), fresh)
    assert {r.filename: r.content_sha256 for r in good.collect()} == {"a.pdf": hashlib.sha256(b"one, changed").hexdigest(), "b.eml": hashlib.sha256(b"two").hexdigest()}
    gone = spark.createDataFrame([(f"file:{folder}/lost.pdf", *fresh.first()[1:3], "lost.pdf", "pdf")], files.LISTED)
    assert [r.reason for r in files.scan_files(spark, str(folder), gone)[1].collect()] == ["unreadable"]


def test_readers_see_the_old_version_during_and_after_a_failed_write(spark, tmp_path, monkeypatch):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=2)
    assert index.read().count() == 0
    index.write(_chunks(spark, [(1, f, 0, f"old {f}") for f in range(3)]))
    before = index.read()
    monkeypatch.setattr(index, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):  # all folders are written, the commit isn't
        index.write(_chunks(spark, [(1, 0, 0, "new"), (1, 9, 0, "new")]), gone=spark.createDataFrame([(1, 1)], "matter_id long, file_id long"))
    monkeypatch.undo()
    for rows in (before, index.read()):
        assert sorted((r.file_id, r.text) for r in rows.collect()) == [(f, f"old {f}") for f in range(3)]
    index.write(_chunks(spark, [(1, 0, 0, "newer")]))
    assert sorted(r.text for r in before.collect()) == ["old 0", "old 1", "old 2"]  # a reader that began earlier
    assert sorted(r.text for r in index.read().collect()) == ["newer", "old 1", "old 2"]
    assert len(index.vacuum()) == 4 and sorted(r.text for r in index.read().collect()) == ["newer", "old 1", "old 2"]


def test_a_purge_rewrites_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    index = ChunkIndex(spark, folder, buckets=2)
    index.write(_chunks(spark, [(1, f, i, f"{f} {i}") for f in range(20) for i in range(5)]))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / "data").rglob("*.parquet")}
    index.write(gone=spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "matter_id long, file_id long"))
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / "data").rglob("*.parquet")} == files
    assert {r.file_id for r in index.read().collect()} == set(range(20)) - {3, 4}
    index.write(_chunks(spark, [(1, 3, 0, "back")]))
    assert [r.text for r in index.read().filter("file_id = 3").collect()] == ["back"]
    assert {r.file_id for r in index.read(version=1).collect()} == set(range(20))


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"))
    index.write(_chunks(spark, [(1, 1, 0, "a")]))
    with pytest.raises(IndexChanged):
        index._commit(1, [])
    assert index.write(_chunks(spark, [(1, 2, 0, "b")]), write_id="x") == 2
    assert index.write(_chunks(spark, [(1, 2, 0, "other")]), write_id="x") == 2  # delivered again
    assert sorted(r.text for r in index.read().collect()) == ["a", "b"]


def test_compaction_keeps_what_is_live_and_the_tombstones_of_older_writes(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=2)
    gone = spark.createDataFrame([(1, 2)], "matter_id long, file_id long")
    index.write(_chunks(spark, [(1, 1, 0, "a"), (1, 2, 0, "b"), (1, 3, 0, "c")]))
    index.write(_chunks(spark, [(1, 3, 0, "c2"), (1, 4, 0, "d")]))
    index.write(_chunks(spark, [(1, 4, 0, "d2")]), gone=gone)
    want = ["a", "c2", "d2"]
    for newest in (2, None):
        index.compact(newest)
        assert sorted(r.text for r in index.read().collect()) == want
        index.vacuum()
        assert sorted(r.text for r in index.read().collect()) == want
    assert len(index.manifest()["writes"]) == 1 and index.write(_chunks(spark, [(1, 1, 0, "a2")])) == 6
    assert sorted(r.text for r in index.read().collect()) == ["a2", "c2", "d2"]


def test_only_buckets_that_may_hold_a_content_are_read(spark, tmp_path):
    index = ChunkIndex(spark, str(tmp_path / "index"), buckets=16)
    rows = spark.createDataFrame([(1, f, 0, f"t{f}", f"sha{f}") for f in range(400)], "matter_id long, file_id long, chunk_index int, text string, content_sha256 string")
    index.write(rows)
    asked = spark.createDataFrame([(1, "sha7"), (2, "sha7"), *[(1, f"other{i}") for i in range(30)]], "matter_id long, content_sha256 string")
    held = index.holders(asked)
    assert [tuple(r) for r in held.collect()] == [(1, "sha7", 7)]
    assert 1 <= len(index.buckets_to_read(asked, index.manifest()["writes"])) <= 3
    assert "PartitionFilters: [isnotnull(content_bucket" in held._jdf.queryExecution().executedPlan().toString()
    assert index.holders(asked.filter("content_sha256 LIKE 'other%'")).count() == 0
    index.write(gone=spark.createDataFrame([(1, 7)], "matter_id long, file_id long"))
    assert index.holders(asked).count() == 0


def test_membership_filters(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("key"))
    filters = membership.build(keys, 4)
    assert membership.probe(filters, keys, 4).count() == 3000
    assert membership.probe(filters, others, 4).count() < 100


def test_index_metadata_and_result_tables(spark, tmp_path):
    df = spark.createDataFrame([("c", [1.0, 2.0], "m", "s"), ("c", [1.0, 2.0], None, "s")], "collection string, embedding array<float>, embed_model string, content_sha256 string")
    assert sinks.index_metadata(df).first().asDict() == {"collection": "c", "chunks": 2, "dim": 2, "embed_model": "m", "content_sha256": "s"}


def test_results_with_one_title_both_survive_and_a_repeated_write_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    schema = "result_id string, task string, table_title string, row_no int, cells array<string>, structured boolean, note string"
    for version, rows in ((0, [("r1", 1, "a"), ("r2", 1, "b")]), (1, [("r3", 1, "c"), ("r2", 1, "d"), ("r2", 2, "e")]), (1, [("r3", 1, "c"), ("r2", 1, "d"), ("r2", 2, "e")])):
        tables = spark.createDataFrame([(r, "timeline", "Timeline", n, [c], True, "") for r, n, c in rows], schema)
        sinks.write_result_tables(tables, folder, version)
    back = sinks.read_result_tables(spark, folder).orderBy("result_id", "row_no").collect()
    assert [(b.result_id, b.task, b.table_title, b["cells"]) for b in back] == [(r, "timeline", "Timeline", [c]) for r, c in (("r1", "a"), ("r2", "d"), ("r2", "e"), ("r3", "c"))]


def test_nested_catalogue(spark):
    nested = {"court": {"ordinary": {
        "defence": {"description": "d", "rule_citation": "Rule 1", "required_documents": [{"name": "A", "form_number": "18A", "notes": ""}, {"name": "B", "form_number": None, "notes": "n"}]},
        "other": {"description": "e", "rule_citation": "Rule 2", "required_documents": []},
    }}}
    flat = catalogues.flatten_catalogue(spark.createDataFrame([(json.dumps(nested),)], "value string"))
    assert {(r.deadline, r.doc_no, r.name, r.form_number) for r in flat.collect()} == {("defence", 0, "A", "18A"), ("defence", 1, "B", None), ("other", None, None, None)}


def test_model_catalogue(spark):
    rows = [("b/x", None, ("0.000005", "0.000025"), 10), ("a/y", " Y ", ("0.0000005", "0.0000008"), None), ("", "none", ("1", "1"), 1), ("free", None, (None, None), 5), ("c/z", None, ("oops", "0.00001"), 5)]
    df = spark.createDataFrame(rows, "id string, name string, pricing struct<prompt string, completion string>, context_length int")
    got = {r.id: (r.name, r.provider, r.price_per_million, r.tier) for r in catalogues.normalise_models(df).collect()}
    assert got == {"b/x": ("b/x", "b", 30.0, "$$$"), "a/y": ("Y", "a", 1.3, "$"), "free": ("free", "", 0.0, "$"), "c/z": ("c/z", "c", 0.0, "$")}


@pytest.mark.parametrize("name, want", [("a.b.PDF", ".pdf"), ("noext", ""), ("x.docx", ".docx")])
def test_suffix(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(files.suffix_of(F.col("n"))).first()[0] == want


def test_texts_become_one_file_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, "zwei \u00e9"), (3, ""), (2, "zwei \u00e9"), (4, "a\nb")], "id long, t string")
    for _ in range(2):  # written again, a file replaces itself
        folders = files.write_texts(rows, f"file://{tmp_path}/texts", "id", "t", 3)
    assert len(folders) == 3 and all(spark.read.format("binaryFile").load(f) is not None for f in folders)
    listed = files.list_corpus(spark, f"file://{tmp_path}/texts")
    good, bad = files.scan_files(spark, f"file://{tmp_path}/texts", listed, suffixes=(".txt",))
    want = {1: b"one\n", 2: "zwei \u00e9\nzwei \u00e9\n".encode(), 3: b"\n", 4: b"a\nb\n"}
    assert {r.filename: (r.length, r.content_sha256) for r in good.collect()} == {f"id={k}.txt": (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}
    assert bad.count() == 0 and sorted(p.name for p in (tmp_path / "texts").rglob("*") if p.is_file()) == [f"id={k}.txt" for k in want]


def test_small_files_are_read_many_a_task(spark, tmp_path):
    files.write_texts(spark.range(300).selectExpr("id", "'x' AS t"), f"{tmp_path}/texts", "id", "t", 1)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
        assert files.list_corpus(spark, f"{tmp_path}/texts").rdd.getNumPartitions() < 40  # 75 at four files a task
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_pages_are_scanned_by_folder_and_each_once(spark, tmp_path, monkeypatch):
    from casefile_spark.plans import corpus_queries as Q

    monkeypatch.setattr(files, "FOLDER_FILES", 4)
    scanned, scan_files = [], files.scan_files

    def scan(spark, folder, wanted, **more):
        scanned.append((folder, [int(r.filename[8:-4]) for r in wanted.collect()]))
        return scan_files(spark, folder, wanted, **more)

    monkeypatch.setattr(files, "scan_files", scan)
    pages = [(i, "u", None if i == 3 else f"<p>{i}</p>") for i in range(11)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in Q.a1_corpus_scan(spark, str(tmp_path)).collect()}
    bodies = {i: ((html or "") + "\n").encode() for i, _, html in pages}
    sha = {i: hashlib.sha256(b).hexdigest() for i, b in bodies.items()}
    assert {i: (r.scan, r.length, r.content_sha256, r.collection) for i, r in got.items()} == {i: (1 + i % 2, len(b), sha[i], f"day1-{sha[i][:16]}") for i, b in bodies.items()}
    assert len({f for f, _ in scanned}) == 3 and sorted(i for _, ids in scanned for i in ids) == [*range(11)]
