"""Whole-corpus scans for time-bar and document-type signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generate import inline_rows
from ..functions.text import join_sorted

# The lexicon in order, the hallmark phrases, the year rule and wording.
LIMITATION_LEXICON = (
    r"limitation period", r"limitations act", r"statute[- ]barred", r"time[- ]barred", r"out of time",
    r"ultimate limitation", r"discoverab", r"limitation defence", r"two[- ]year limitation", r"\blimitation\b",
    r"\bexpired\b", r"\bdeadline\b", r"\b\d+[\s-]?(?:day|days|week|weeks|month|months)\b",
    r"within \d+\s*(?:day|days|week|weeks|month|months|year|years)", r"served within", r"notice period",
    r"\blaches\b", r"prescription", r"prescribed period", r"intervening period", r"evidentiary",
)
HALLMARKS = (
    "statement of claim", "plaintiff's claim", "plaintiff", "defendant", "to the defendant", "you are hereby",
    "superior court of justice", "small claims court", "court file no", "claim no",
)
HALLMARK_MINIMUM = 2
LIMITATION_YEARS = 2
YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"
OWN_TEXT = "(your claim particulars)"
TERM_SIGNAL = 'the matter text mentions "%s" - review whether a limitation period or deadline applies'
YEAR_SIGNAL = (
    "the matter references the year %d, more than %d years before %d - a limitation period may already have run"
)
NOT_SCANNED = (
    "The limitation review could not read %d file(s) in this matter (%s); they were NOT scanned for "
    "limitation signals. Re-ingest them before relying on this review."
)


def term_signals(chunks: DataFrame, keys: list[str], order: list[str], lexicon: tuple[str, ...] = LIMITATION_LEXICON) -> DataFrame:
    """Distinct matched terms per key with pattern number and first position, in one scan.

    The pattern list is static, so each chunk yields one array of matches; what leaves the scan is the
    distinct (pattern, term) pairs of a chunk, combined per key before the shuffle.
    """
    low = F.lower("text")

    def matches(number: int, pattern: str) -> Column:
        terms = F.transform(F.regexp_extract_all(low, F.lit(f"(?U)({pattern})"), 1), lambda m: F.trim(m))
        return F.transform(
            F.array_distinct(terms),
            lambda t, i: F.struct(F.lit(number).alias("pattern_no"), i.alias("term_no"), t.alias("term")),
        )

    per_pattern = [matches(n, p) for n, p in enumerate(lexicon)]
    found = inline_rows(chunks, [*keys, *order], F.flatten(F.array(*per_pattern)), "term").filter(F.col("term") != "")
    return found.groupBy(*keys, "term").agg(
        F.min(F.struct("pattern_no", *order, "term_no")).alias("first_at"), F.count("*").alias("chunks")
    )


def oldest_years(chunks: DataFrame, keys: list[str], as_of_year: int, pattern: str = YEAR_PATTERN) -> DataFrame:
    """Oldest year per key where it lies far enough back to matter."""
    years = F.regexp_extract_all("text", F.lit(f"(?U)({pattern})"), 1)
    smallest = F.array_min(F.transform(years, lambda y: y.try_cast("int")))
    per_key = chunks.groupBy(*keys).agg(F.min(smallest).alias("oldest"))
    return per_key.filter(F.col("oldest") <= as_of_year - LIMITATION_YEARS)


def signals(chunks: DataFrame, keys: list[str], order: list[str], as_of_year: int) -> DataFrame:
    """All signal messages per key: terms in lexicon then text order, the year last."""
    terms = term_signals(chunks, keys, order)
    a = terms.select(
        *keys, F.lit(0).alias("kind"), "first_at", F.format_string(TERM_SIGNAL, "term").alias("signal"),
    )
    at_end = F.lit(None).cast(terms.schema["first_at"].dataType)
    b = oldest_years(chunks, keys, as_of_year).select(
        *keys, F.lit(1).alias("kind"), at_end.alias("first_at"),
        F.format_string(YEAR_SIGNAL, "oldest", F.lit(LIMITATION_YEARS), F.lit(as_of_year)).alias("signal"),
    )
    return a.unionByName(b)


def signals_by_file(chunks: DataFrame, own_text: DataFrame, as_of_year: int) -> DataFrame:
    """Signals per request and file, the request's own text as a last pseudo-file.

    chunks: request_id, file_pos, filename, chunk_no, text. own_text: request_id, text.
    """
    own = own_text.filter(F.coalesce("text", F.lit("")) != "").select(
        "request_id", F.lit(2**31 - 1).alias("file_pos"), F.lit(OWN_TEXT).alias("filename"), F.lit(0).alias("chunk_no"), "text"
    )
    every = chunks.select("request_id", F.col("file_pos").cast("int").alias("file_pos"), "filename", F.col("chunk_no").cast("int").alias("chunk_no"), "text").unionByName(own)
    return signals(every, ["request_id", "file_pos", "filename"], ["chunk_no"], as_of_year)


def union_in_order(by_file: DataFrame) -> DataFrame:
    """Distinct signals per request, in order of first appearance over the files."""
    return by_file.groupBy("request_id", "signal").agg(F.min(F.struct("file_pos", "kind", "first_at")).alias("first_seen"))


def gate(requests: DataFrame, by_file: DataFrame, unread: DataFrame) -> DataFrame:
    """refused when signals exist and were not confirmed; unread files are named either way.

    requests: request_id, confirmed. unread: request_id, file_pos, filename.
    """
    counts = by_file.groupBy("request_id").agg(
        F.count_distinct("signal").alias("signals"), F.count_distinct("filename").alias("files_with_signals")
    )
    names = unread.groupBy("request_id").agg(
        F.count("*").alias("unscanned"), join_sorted(F.collect_list(F.struct("file_pos", F.col("filename").alias("value"))), ", ").alias("_names")
    )
    hit = F.coalesce("signals", F.lit(0)) > 0
    return (
        requests.join(counts, "request_id", "left").join(names, "request_id", "left")
        .select(
            "request_id",
            F.coalesce("signals", F.lit(0)).alias("signals"),
            F.coalesce("files_with_signals", F.lit(0)).alias("files_with_signals"),
            F.when(hit & ~F.coalesce("confirmed", F.lit(False)), "refused").otherwise("proceed").alias("gate"),
            F.coalesce("unscanned", F.lit(0)).alias("unscanned"),
            F.when(F.col("unscanned") > 0, F.format_string(NOT_SCANNED, "unscanned", "_names")).alias("warning"),
        )
    )


def hallmarks(chunks: DataFrame, keys: list[str], phrases: tuple[str, ...] = HALLMARKS) -> DataFrame:
    """How many of the phrases occur anywhere in the key's texts, and whether that is enough."""
    low = F.lower("text")
    seen = [F.max(low.contains(p).cast("int")).alias(f"_h{i}") for i, p in enumerate(phrases)]
    total = sum((F.coalesce(f"_h{i}", F.lit(0)) for i in range(len(phrases))), F.lit(0))
    return chunks.groupBy(*keys).agg(*seen).select(*keys, total.alias("hallmarks")).withColumn(
        "looks_like_pleading", F.col("hallmarks") >= HALLMARK_MINIMUM
    )

