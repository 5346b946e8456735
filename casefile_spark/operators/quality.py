"""Extraction quality, ingest decisions, status lifecycle and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import legible_chars

# Thresholds, statuses, labels and user-facing wording.
MIN_CHARS_PER_PAGE = 150
MIN_LEGIBLE_RATIO = 0.85
QUERYABLE = ("ingested", "ocr_low_quality")
STATUS_LABELS = {
    "ingested": "Ready",
    "ocr_low_quality": "Poor scan quality",
    "failed_no_text": "No readable text",
    "password_protected": "Password protected",
    "failed": "Ingest failed",
    "pending": "Not yet processed",
}
NO_TEXT = "No readable text was extracted from this file."
SPARSE = (
    "Scanned pages produced only %d characters per page on average (typical is over 1,500). "
    "The scan may be too faint, skewed, or low-resolution to read."
)
ILLEGIBLE = (
    "Only %d%% of the recognised characters look like normal text, so the scan was probably misread. "
    "A clearer copy would give better results."
)
INDEX_REASON = {
    "missing": "Its search index is missing.",
    "empty": "Its search index contains no text.",
    "unreadable": "Its search index could not be read.",
}
REUPLOAD = " Re-upload this file to make it searchable again."


def extraction_measures(pages: DataFrame) -> DataFrame:
    """pages: file_id, text, is_ocr. Characters are summed per page, so a long file stays spread out."""
    return pages.groupBy("file_id").agg(
        F.count("*").alias("pages"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(legible_chars(F.col("text"))).alias("_legible"),
        F.bool_or("is_ocr").alias("any_ocr"),
    )


def whole(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def extraction_verdict(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Per file: chars, chars_per_page, legible_ratio, quality, quality_detail."""
    m = files.select("file_id").join(extraction_measures(pages), "file_id", "left")
    chars = F.coalesce("chars", F.lit(0))
    per_page = F.when(F.col("pages") > 0, chars / F.col("pages")).otherwise(0.0)
    ratio = F.when(chars > 0, F.col("_legible") / chars).otherwise(1.0)
    scanned = F.coalesce("any_ocr", F.lit(False))
    quality = (
        F.when(F.coalesce("pages", F.lit(0)) == 0, "failed_no_text")
        .when(scanned & ((F.col("chars_per_page") < MIN_CHARS_PER_PAGE) | (F.col("legible_ratio") < MIN_LEGIBLE_RATIO)), "ocr_low_quality")
        .otherwise("ok")
    )
    detail = (
        F.when(F.col("quality") == "failed_no_text", NO_TEXT)
        .when(F.col("quality") == "ok", "")
        .when(F.col("chars_per_page") < MIN_CHARS_PER_PAGE, F.format_string(SPARSE, whole(F.col("chars_per_page"))))
        .otherwise(F.format_string(ILLEGIBLE, whole(F.col("legible_ratio") * 100)))
    )
    return (
        m.withColumn("chars_per_page", per_page)
        .withColumn("legible_ratio", ratio)
        .withColumn("quality", quality)
        .select("file_id", chars.alias("chars"), "chars_per_page", "legible_ratio", "quality", detail.alias("quality_detail"))
    )


def ingest_outcome(verdict: DataFrame, chunks: DataFrame, reindexed: DataFrame) -> DataFrame:
    """One row per file: chunk count from the chunk table, measures, quality and reindexed flag."""
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("chunk_count"))
    return (
        verdict.join(counts, "file_id", "left")
        .join(reindexed.select("file_id", F.lit(True).alias("_r")), "file_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .withColumn("was_reindexed", F.coalesce("_r", F.lit(False)))
        .drop("_r")
    )


# --- duplicates and upload decisions ---------------------------------------------------------
def first_copies(files: DataFrame, order: list[str]) -> DataFrame:
    """Earliest file per (matter, content): combined map-side, so a mass of copies shuffles as one row."""
    return files.groupBy("matter_id", "content_sha256").agg(
        F.min_by("file_id", F.struct(*order)).alias("kept_file_id"), F.count("*").alias("copies")
    )


def duplicate_uploads(files: DataFrame, order: list[str]) -> DataFrame:
    """Files whose bytes an earlier file of the same matter already holds."""
    repeated = first_copies(files, order).filter(F.col("copies") > 1)
    return (
        files.join(repeated, ["matter_id", "content_sha256"])
        .filter(F.col("file_id") != F.col("kept_file_id"))
        .select("matter_id", "file_id", "kept_file_id", "content_sha256")
    )


def upload_actions(staged: DataFrame, manifest: DataFrame) -> DataFrame:
    """restore, duplicate or insert per staged file, against the manifest incl. soft-deleted rows.

    staged: matter_id, upload_id, content_sha256. manifest: matter_id, file_id, content_sha256, deleted_at.
    Among staged copies of new content the first is inserted and the rest are duplicates.
    """
    keys = ["matter_id", "content_sha256"]
    held = manifest.groupBy(*keys).agg(
        F.min(F.when(F.col("deleted_at").isNull(), F.col("file_id"))).alias("_live"),
        F.min(F.when(F.col("deleted_at").isNotNull(), F.col("file_id"))).alias("_gone"),
    )
    first = staged.groupBy(*keys).agg(F.min("upload_id").alias("_first"))
    lead = first.join(held, keys, "left")
    action = (
        F.when(F.col("_live").isNotNull(), "duplicate")
        .when(F.col("upload_id") != F.col("_first"), "duplicate")
        .when(F.col("_gone").isNotNull(), "restore")
        .otherwise("insert")
    )
    return staged.join(lead, keys).select(
        "matter_id", "upload_id", "content_sha256", action.alias("action"),
        F.coalesce("_live", "_gone").alias("existing_file_id"),
    )


def files_to_index(files: DataFrame, chunks: DataFrame, force: bool | Column = False) -> DataFrame:
    """Files without a single stored chunk, or all of them when forced."""
    counts = chunks.groupBy("file_id").agg(F.count("*").alias("indexed"))
    forced = F.lit(force) if isinstance(force, bool) else force
    return (
        files.join(counts, "file_id", "left")
        .withColumn("indexed", F.coalesce("indexed", F.lit(0)))
        .filter((F.col("indexed") == 0) | forced)
    )


def verify_written(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Recount from the stored rows: a file that was to be indexed and holds nothing has failed."""
    counts = stored.groupBy("file_id").agg(F.count("*").alias("indexed"))
    return (
        expected.select("file_id").join(counts, "file_id", "left")
        .select(
            "file_id",
            F.coalesce("indexed", F.lit(0)).alias("indexed"),
            F.when(F.col("indexed") > 0, "ingested").otherwise("failed_no_text").alias("ingest_status"),
        )
    )


# --- status lifecycle ------------------------------------------------------------------------
def latest_status(events: DataFrame) -> DataFrame:
    """events: file_id, status, error, at, event_id -> the newest status per file."""
    newest = F.max_by(F.struct("status", "error"), F.struct("at", "event_id"))
    return events.groupBy("file_id").agg(newest.alias("_s")).select(
        "file_id",
        F.col("_s.status").alias("ingest_status"),
        F.col("_s.error").alias("ingest_error"),
        is_queryable(F.col("_s.status")).alias("queryable"),
        status_label(F.col("_s.status")).alias("label"),
    )


def is_queryable(status: Column) -> Column:
    return F.coalesce(status.isin(*QUERYABLE), F.lit(False))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


def probe_indexes(files: DataFrame, index: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """ok, missing, empty or unreadable per queryable file.

    index: collection - the registered collections. chunks: collection, embedding. A stored vector of
    another size than ``dim`` makes a collection unreadable.
    """
    held = chunks.groupBy("collection").agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).alias("_bad")
    )
    known = index.select("collection").distinct().withColumn("_known", F.lit(True))
    state = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.coalesce("_n", F.lit(0)) == 0, "empty")
        .when(F.col("_bad") > 0, "unreadable")
        .otherwise("ok")
    )
    return (
        files.filter(is_queryable(F.col("ingest_status")) & (F.coalesce("collection", F.lit("")) != ""))
        .join(known, "collection", "left")
        .join(held, "collection", "left")
        .withColumn("state", state)
        .drop("_known", "_n", "_bad")
    )


def reconcile_health(probed: DataFrame, store_available: bool = True) -> DataFrame:
    """Status events that demote every file whose index is not usable; none if the store is down."""
    reasons = F.create_map(*[F.lit(x) for pair in INDEX_REASON.items() for x in pair])
    return (
        probed.filter((F.col("state") != "ok") & F.lit(store_available))
        .select(
            "file_id", "matter_id", "state",
            F.lit("failed_no_text").alias("ingest_status"),
            F.concat(reasons[F.col("state")], F.lit(REUPLOAD)).alias("ingest_error"),
        )
    )


def health_summary(probed: DataFrame) -> DataFrame:
    return probed.agg(F.count("*").alias("checked"), F.count_if(F.col("state") != "ok").alias("demoted"))


def files_to_reprocess(files: DataFrame, matter_id: int, file_id: int | None = None) -> DataFrame:
    """One named file, or every file of the matter that cannot be searched."""
    mine = files.filter(F.col("matter_id") == matter_id)
    if file_id is not None:
        return mine.filter(F.col("file_id") == file_id)
    return mine.filter(~is_queryable(F.col("ingest_status")))
