"""The two everyday jobs, each as one chain of operators over all files or all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import prompts as P
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import shortlist as S
from ..sources.files import collection_name
from ..sources.pages import readable_pages, triage_pages


def ingest_pages(files: DataFrame, page_text: DataFrame) -> dict[str, DataFrame]:
    """Pages of new files to chunks, a verdict and a status per file; one bad file never fails the job.

    files: file_id, matter_id, filename, content_sha256. page_text as for ``triage_pages``.
    """
    triaged = triage_pages(page_text)
    readable = readable_pages(triaged)
    verdict = Q.extraction_verdict(files, readable)
    head = files.select("file_id", "matter_id", F.col("filename").alias("source"), "content_sha256")
    windows = C.page_chunks(readable, ["file_id", "page_no", "is_ocr"]).join(head, "file_id")
    # Chunks are numbered by page and window, which is stable whatever else is in the job.
    index = F.col("page_no") * 100_000 + F.col("window_no")
    chunks = windows.select(
        "matter_id", "file_id", "source", "locator", index.alias("chunk_index"), "text", "content_sha256",
        collection_name(F.col("matter_id"), F.col("content_sha256")).alias("collection"),
        C.chunk_id(F.col("content_sha256"), index, F.col("text")).alias("chunk_id"),
    )
    status = F.when(F.col("quality") == "ok", "ingested").otherwise(F.col("quality"))
    return {"chunks": chunks, "verdict": verdict, "status": verdict.select("file_id", status.alias("ingest_status"), F.col("quality_detail").alias("ingest_error"))}


def prepare_prompts(requests: DataFrame, requested: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Ranked passages of every request as one message, with its coverage and contributing sources.

    requests: query_id, embedding, override, detail_level, template_depth, label, inputs.
    requested: query_id, collection, collection_pos. manifest: collection, filename. A request none of
    whose files can be read fails the job. Every request searches the collections it names.
    """
    depth = R.answer_depth(F.col("override"), F.col("detail_level"), F.col("template_depth"))
    queries = requests.select("query_id", depth.alias("k"), "embedding")
    per_file = R.search_per_file(chunks, queries, requested).filter(F.col("rank").isNotNull())
    hits = R.best_of(per_file, queries)
    passages = R.with_passages(hits, chunks)
    coverage = R.partial_warning(R.require_coverage(R.coverage_report(requested, chunks)), manifest)
    sources = R.contributors(passages, ["source"]).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "source"))), lambda s: s["source"]).alias("sources")
    )
    texts = requests.select("query_id", P.request_section(F.col("label"), F.col("inputs")).alias("request_text"))
    return P.context_message(passages, texts).join(coverage, "query_id", "left").join(sources, "query_id", "left")


def searched_cases(requests: DataFrame, queries: DataFrame, cases: DataFrame, as_of_year: int) -> DataFrame:
    """Cases of every request from its own searches to the first ranking: search, merge by citation, filter, score.

    requests: request_id, wanted, span, earliest_year. queries: request_id, query_no, angle, query. cases: case_no, citation,
    database_id, tier, jurisdiction, decision_date, text. A case that several queries find is one row with all its angles.
    """
    asked = queries.withColumn("query_id", F.concat_ws(":", F.col("request_id").cast("string"), F.col("query_no").cast("string")))
    found = S.search_corpus(cases.select(F.col("case_no").alias("doc_id"), "text"), asked.select("query_id", "query"))
    known = cases.select("case_no", "citation", "database_id", "tier", "jurisdiction", "decision_date")
    hits = found.withColumnRenamed("doc_id", "case_no").join(asked.select("query_id", "request_id", "query_no", "angle"), "query_id").join(known, "case_no")
    hits = hits.withColumn("merge_key", S.merge_key(F.col("citation"), F.col("database_id"), F.col("case_no").cast("string")))
    merged = S.merge_hits(hits, known.columns).join(requests, "request_id")
    merged = merged.withColumn("effective_year", S.effective_year(F.col("decision_date"), S.citation_year(F.col("citation"), as_of_year)))
    kept = merged.filter(S.passes_filters(F.col("earliest_year"), F.col("wanted"))).withColumn("angles", F.size("found_by"))
    return S.stage_one(kept, as_of_year)
