"""Retrieval: exact cosine top-k in four shapes, with a coverage report.

Chunk table: collection, collection_pos, chunk_no, chunk_key, embedding, source, locator, text.
Request table: query_id, collection, collection_pos - the collections each query asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import join_sorted, strip
from ..functions.topk import SCORE_DIGITS, cosine_top_k

# Depths, budgets, limits, thresholds and wording.
DETAILED_DEPTH = 28
COMPARE_MIN_FILES = 2
COMPARE_MAX_FILES = 20
COMPARE_BUDGET = 40
COMPARE_MIN_DEPTH = 3
SNIPPET_CHARS = 160
PARITY_MIN = 0.9999
PARTIAL = (
    "Retrieved from %d of %d files. %d file(s) could not be read from the search index "
    "and did not contribute to this answer: %s. Open the matter to re-process them."
)
NONE_READABLE = (
    "None of the %d file(s) in this matter could be read from the search index. The index may be "
    "damaged; run Diagnostics from the matter page and re-ingest the affected files."
)
TOO_FEW = "Compare Clauses needs at least 2 documents to compare; %d selected."
TOO_MANY = (
    "Compare Clauses is limited to 20 files; %d selected. Use the file selector to restrict the "
    "comparison to at most 20 files."
)


# --- top-k -----------------------------------------------------------------------------------
def search_one(chunks: DataFrame, collection: str, queries: DataFrame) -> DataFrame:
    """Top-k inside one collection; fewer rows if it holds fewer."""
    return cosine_top_k(chunks.filter(F.col("collection") == collection), queries)


def search_across(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Top-k over all collections at once; ties go by collection order, then order inside it."""
    return cosine_top_k(chunks, queries)


def search_per_file(chunks: DataFrame, queries: DataFrame, requested: DataFrame) -> DataFrame:
    """Top-k inside every requested collection, total over the request list.

    Only the requested pairs of query and collection are scored; the limit runs before the shuffle of
    the scores. A requested collection without hits keeps one row with a NULL rank.
    """
    deepest = _deepest(queries)
    asked = requested.select("query_id", "collection").join(
        queries.select("query_id", F.col("k").alias("_k"), F.col("embedding").alias("_q")), "query_id"
    )
    pairs = chunks.select("collection", "chunk_no", F.col("chunk_key").cast("string").alias("chunk_key"), "embedding").join(asked, "collection")
    scored = pairs.filter(F.size("embedding") == F.size("_q")).select(
        "query_id", "collection", "chunk_no", "chunk_key", "_k",
        F.round(vectors.cosine(F.col("_q"), F.col("embedding")), SCORE_DIGITS).alias("score"),
    )
    best = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "chunk_no", "chunk_key")
    hits = (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= deepest).filter(F.col("rank") <= F.col("_k"))
        .select("query_id", "collection", "rank", "score", "chunk_no", "chunk_key")
    )
    return requested.select("query_id", "collection", "collection_pos").join(hits, ["query_id", "collection"], "left")


def _deepest(queries: DataFrame) -> int:
    """One number for the driver: a constant bound lets a window limit run before the shuffle."""
    return int(queries.agg(F.max("k")).first()[0] or 0)


def best_of(per_file: DataFrame, queries: DataFrame) -> DataFrame:
    """Global top-k of per-file hits. Nothing is lost: a global hit is a hit of its own file."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "collection_pos", "chunk_no", "chunk_key")
    ranked = per_file.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _deepest(queries))
    return ranked.join(queries.select("query_id", "k"), "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


def with_passages(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch source, locator and text for the ranked rows only, after the ranking."""
    return hits.join(
        chunks.select(F.col("chunk_key").cast("string").alias("chunk_key"), "source", "locator", "text"), "chunk_key", "left"
    )


def grouped_hits(per_file: DataFrame) -> DataFrame:
    """One row per (query, requested collection) with its hits in rank order, empty when none."""
    entry = F.when(F.col("rank").isNotNull(), F.struct("rank", "chunk_key", "score"))
    return per_file.groupBy("query_id", "collection", "collection_pos").agg(
        F.array_sort(F.collect_list(entry)).alias("hits")
    )


# --- depth -----------------------------------------------------------------------------------
def compare_depth(base: Column, n_files: Column, override: Column) -> Column:
    """Passages per file for a comparison; an explicit depth bypasses the budget."""
    share = F.floor(F.lit(COMPARE_BUDGET) / n_files)
    fitted = F.greatest(F.lit(COMPARE_MIN_DEPTH), F.least(base, share))
    return F.coalesce(override, F.when(n_files <= 0, base).otherwise(fitted)).cast("int")


def compare_plan(requests: DataFrame) -> DataFrame:
    """requests: query_id, n_files, base_depth, override -> depth, refusal, over_budget."""
    n = F.col("n_files")
    refusal = F.when(n < COMPARE_MIN_FILES, F.format_string(TOO_FEW, n)).when(
        n > COMPARE_MAX_FILES, F.format_string(TOO_MANY, n)
    )
    planned = requests.withColumn("refusal", refusal).withColumn(
        "depth", F.when(F.col("refusal").isNull(), compare_depth(F.col("base_depth"), n, F.col("override")))
    )
    return planned.withColumn("over_budget", F.col("depth") * n > COMPARE_BUDGET)


def answer_depth(override: Column, detail_level: Column, template_depth: Column) -> Column:
    return F.coalesce(override, F.when(detail_level == "Detailed", DETAILED_DEPTH), template_depth).cast("int")


# --- coverage --------------------------------------------------------------------------------
def coverage_report(requested: DataFrame, readable: DataFrame) -> DataFrame:
    """Per query: attempted, answered, skipped collections in request order."""
    ok = readable.select("collection").distinct().withColumn("_ok", F.lit(True))
    missing = F.when(F.col("_ok").isNull(), F.struct("collection_pos", F.col("collection").alias("value")))
    return (
        requested.join(ok, "collection", "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("attempted"),
            F.count("_ok").alias("answered"),
            F.array_sort(F.collect_list(missing)).alias("_skipped"),
        )
        .withColumn("skipped", F.transform("_skipped", lambda s: s["value"]))
        .drop("_skipped")
    )


def readable(chunks: DataFrame, dim: int) -> DataFrame:
    """Collections that queries of ``dim`` numbers can read: those with a vector of that size."""
    return chunks.filter(F.size("embedding") == dim).select("collection").distinct()


def require_coverage(report: DataFrame) -> DataFrame:
    """Fail the job when a query could read none of its collections: that is not an empty result."""
    nothing = (F.col("attempted") > 0) & (F.col("answered") == 0)
    checked = F.when(nothing, F.raise_error(F.format_string(NONE_READABLE, "attempted")).cast("long")).otherwise(
        F.col("answered")
    )
    return report.withColumn("answered", checked)


def partial_warning(report: DataFrame, manifest: DataFrame) -> DataFrame:
    """Warning per query with the file names behind the skipped collections; NULL when complete."""
    names = manifest.groupBy("collection").agg(F.min("filename").alias("filename"))
    named = (
        report.select("query_id", F.posexplode("skipped").alias("_i", "collection"))
        .join(names, "collection", "left")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("_i", F.coalesce("filename", "collection").alias("value"))).alias("_n"))
    )
    text = F.format_string(
        PARTIAL, "answered", "attempted", F.col("attempted") - F.col("answered"), join_sorted(F.col("_n"), ", ")
    )
    return report.join(named, "query_id", "left").select(
        "query_id", "attempted", "answered", F.when(F.col("_n").isNotNull(), text).alias("warning")
    )


def scope_sizes(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks in scope per query, counted per collection before the requests meet them."""
    held = chunks.groupBy("collection").agg(F.count("*").alias("_n"))
    return requested.join(held, "collection").groupBy("query_id").agg(F.sum("_n").alias("in_scope"))


def coverage_share(sent: DataFrame, in_scope: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks sent divided by chunks in scope. in_scope: keys and the number of chunks, in_scope."""
    a = sent.groupBy(*keys).agg(F.count("*").alias("sent"))
    return in_scope.join(a, keys, "left").select(
        *keys, F.coalesce("sent", F.lit(0)).alias("sent"), "in_scope",
        (F.coalesce("sent", F.lit(0)) / F.col("in_scope")).alias("share"),
    )


# --- who contributed, what is cited ----------------------------------------------------------
def contributors(hits: DataFrame, per: list[str]) -> DataFrame:
    """Distinct contributing sources (and file ids) with the position of their first hit."""
    order = Window.partitionBy("query_id").orderBy("first_rank", *per)
    return (
        hits.groupBy("query_id", *per)
        .agg(F.min("rank").alias("first_rank"), F.count("*").alias("passages"))
        .withColumn("position", F.row_number().over(order))
    )


def citation_list(passages: DataFrame) -> DataFrame:
    """First passage per (source, locator) in rank order, with a one-line snippet."""
    flat = F.regexp_replace(strip(F.col("text")), "\n", " ")
    snippet = F.when(
        F.length(flat) > SNIPPET_CHARS, F.concat(F.substring(flat, 1, SNIPPET_CHARS), F.lit("..."))
    ).otherwise(flat)
    first = passages.groupBy("query_id", "source", "locator").agg(
        F.min(F.struct("rank", "text")).alias("_f")
    ).select("query_id", "source", "locator", F.col("_f.rank").alias("rank"), F.col("_f.text").alias("text"))
    return first.select("query_id", "source", "locator", "rank", snippet.alias("snippet"))


def gather_chunks(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of every requested file, as rows in file order, then chunk order.

    Rows, not arrays: one file may hold a large share of the corpus.
    """
    return chunks.drop("collection_pos").join(requested, "collection").select(
        "query_id", "collection_pos", "collection", "chunk_no", "source", "text"
    )


# --- parity of two vector sets ---------------------------------------------------------------
def vector_parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Min and mean cosine per collection between two vectors of the same chunk, with a verdict."""
    a = left.select(*keys, "chunk_key", F.col("embedding").alias("_a"))
    b = right.select(*keys, "chunk_key", F.col("embedding").alias("_b"))
    return (
        a.join(b, [*keys, "chunk_key"])
        .select(*keys, vectors.cosine(F.col("_a"), F.col("_b")).alias("_c"))
        .groupBy(*keys)
        .agg(F.count("*").alias("vectors"), F.min("_c").alias("min_cosine"), F.avg("_c").alias("mean_cosine"))
        .withColumn("parity", F.col("min_cosine") >= PARITY_MIN)
    )


def ranking_parity(hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """Per query: do two rankings list the same chunks in the same order?"""
    a = hits_a.select("query_id", "rank", F.col("chunk_key").alias("_a"))
    b = hits_b.select("query_id", "rank", F.col("chunk_key").alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return (
        a.join(b, ["query_id", "rank"], "full")
        .groupBy("query_id")
        .agg(F.count("*").alias("ranks"), F.count_if(~same).alias("differing"), F.bool_and(same).alias("same_ranking"))
    )
