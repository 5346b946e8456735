"""The everyday jobs end to end."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casefile_spark.plans import flows
from casefile_spark.sources import sinks


def test_pages_become_chunks_and_statuses(spark, tmp_path):
    files = spark.createDataFrame([(1, 7, "a.pdf", "sha-a"), (2, 7, "b.pdf", "sha-b"), (3, 7, "c.pdf", "sha-c")], "file_id long, matter_id long, filename string, content_sha256 string")
    long = " ".join(f"w{i}" for i in range(900))
    pages = spark.createDataFrame([(1, 1, long, None, 0.1), (1, 2, "", "scanned words", 0.1), (2, 1, "", "few", 0.2), (3, 1, "", "", 0.995)], "file_id long, page_no int, native_text string, ocr_text string, near_white double")
    out = flows.ingest_pages(files, pages)
    assert [(r.file_id, r.locator) for r in out["chunks"].orderBy("file_id", "chunk_index").collect()] == [(1, "p.1"), (1, "p.1"), (1, "p.2 (OCR)"), (2, "p.1 (OCR)")]
    assert {r.file_id: r.ingest_status for r in out["status"].collect()} == {1: "ingested", 2: "ocr_low_quality", 3: "failed_no_text"}
    folder = str(tmp_path / "index")
    sinks.replace_files(folder, out["chunks"], buckets=2)
    assert sinks.read_chunks(spark, folder).select("chunk_id").distinct().count() == 4


REQUEST = "query_id long, embedding array<double>, override int, detail_level string, template_depth int, label string, inputs array<struct<name string, label string, required boolean, control boolean, values array<string>>>"


def test_requests_become_prompts(spark):
    chunks = spark.createDataFrame(
        [("a", 0, 0, "a0", [1.0, 0.0], "A.pdf", "p.1", "near"), ("a", 0, 1, "a1", [0.9, 0.1], "A.pdf", "p.2", "next"), ("b", 1, 0, "b0", [0.5, 0.5], "B.pdf", "p.1", "mid"), ("c", 2, 0, "c0", [1.0, 0.0], "C.pdf", "p.1", "other")],
        "collection string, collection_pos int, chunk_no int, chunk_key string, embedding array<float>, source string, locator string, text string")
    requests = spark.createDataFrame([(1, [1.0, 0.0], 2, None, 8, "Find", [("q", "Question", True, False, ["who"])]), (2, [0.0, 1.0], None, None, 1, "Find", [])], REQUEST)
    requested = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "gone", 2), (2, "b", 0)], "query_id long, collection string, collection_pos int")
    manifest = spark.createDataFrame([("gone", "Gone.pdf")], "collection string, filename string")
    got = {r.query_id: r for r in flows.prepare_prompts(requests, requested, chunks, manifest).collect()}
    assert got[1].message == "CONTEXT:\n\n[SOURCE: A.pdf p.1]\nnear\n\n[SOURCE: A.pdf p.2]\nnext\n\nREQUEST:\nTask: Find\nQuestion: who"
    assert got[1].sources == ["A.pdf"] and "Gone.pdf" in got[1].warning
    assert got[2].sources == ["B.pdf"] and got[2].warning is None
    with pytest.raises(PySparkException, match="None of the 1 file"):
        flows.prepare_prompts(requests, requested.filter("collection = 'gone'").withColumn("query_id", F.lit(1).cast("long")), chunks, manifest).collect()
