"""Case shortlist: search, merge, filters and two-stage weighted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inverted
from ..functions.generate import inline_rows
from ..functions.text import tokens
from ..session import shared_folder

# Weights, court tiers, limits, stop words and wording.
W_COURT, W_JURISDICTION, W_ANGLES, W_RANK, W_RECENCY, W_SUBJECT = 0.40, 0.20, 0.15, 0.15, 0.10, 0.20
TIER_WEIGHT = {1: 1.00, 2: 0.85, 3: 0.72, 4: 0.60, 5: 0.55, 6: 0.45, 7: 0.40, 8: 0.32, 9: 0.25, 10: 0.18, 11: 0.10}
DEFAULT_TIER = 11
EXCLUDED_DATABASES = ("csc-scc-al",)
SEARCH_PAGE = 100
BROADEN_BELOW = 8
BROADENED_QUERIES = 3
MIN_QUERIES, MAX_QUERIES, MIN_QUERY_CHARS = 3, 10, 8
ENRICH_HEADROOM, ENRICH_CAP = 10, 30
RECENCY_FLOOR = 0.15
MISMATCH_PENALTY = 0.75
SUBJECT_TERMS = 25
WIDEN_ROWS = 500_000  # hits of a task
NOTE_CHARS = 220
SUBJECT_STOPWORDS = (
    "a an the and or of to in on for by with at from as is are was were be been that this these those it its any "
    "all such which who whom whose not no case cases court courts law laws legal act section sections s ss appeal "
    "appellant respondent applicant application motion order"
).split()
NOTE_KEYWORDS = (
    "CanLII classifies this decision under: %s. No further assessment is possible without reading the case."
)
NOTE_TOPIC = (
    'CanLII files this decision under the topic "%s". No further assessment is possible without reading the case.'
)
NOTE_ANGLES = (
    'Surfaced by the "%s" search; CanLII publishes no catchwords for this decision. '
    "No assessment is possible without reading the case."
)
NOTE_WARNING = (
    "%d case(s) below show a note assembled directly from CanLII's catchwords because the model did not "
    "return one for them."
)
FEW_QUERIES = (
    "Only %d usable CanLII queries could be built from this matter and research direction (minimum 3). "
    "Try a more specific research direction."
)


# --- courts ----------------------------------------------------------------------------------
def binding_label(tier: Column, recognised: Column) -> Column:
    return (
        F.when(~recognised, "Court not recognised - verify on CanLII")
        .when(tier.isin(1, 2), "Binding in Ontario")
        .when(tier == 3, "Binding on lower Ontario courts")
        .when(tier.isin(4, 7), "Persuasive within Ontario")
        .when(tier == 8, "Tribunal decision - not binding on a court")
        .when(tier.isin(5, 6), "Federal jurisdiction")
        .otherwise("Persuasive only - out-of-jurisdiction")
    )


def resolve_courts(cases: DataFrame, curated: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Court of every case: curated tier first, then the catalogue at the default tier, else unknown.

    curated: database_id, name, jurisdiction, tier. catalogue: database_id, name, jurisdiction.
    """
    db = F.lower(F.trim(F.coalesce("database_id", F.lit(""))))
    c = curated.select(F.lower("database_id").alias("_db"), F.col("name").alias("_n1"), F.col("jurisdiction").alias("_j1"), F.col("tier").alias("_t1"))
    k = catalogue.select(F.lower("database_id").alias("_db"), F.col("name").alias("_n2"), F.col("jurisdiction").alias("_j2"))
    tier = F.coalesce(F.col("_t1"), F.lit(DEFAULT_TIER)).cast("int")
    known = F.col("_n1").isNotNull() | F.col("_n2").isNotNull()
    return (
        cases.withColumn("_db", db)
        .filter(~F.col("_db").isin(*EXCLUDED_DATABASES))
        .join(c, "_db", "left").join(k, "_db", "left")
        .withColumn("database_id", F.col("_db"))
        .withColumn("court_name", F.coalesce("_n1", "_n2", F.coalesce(F.nullif(F.upper("_db"), F.lit("")), F.lit("(unknown)"))))
        .withColumn("jurisdiction", F.coalesce("_j1", "_j2", F.lit("")))
        .withColumn("tier", tier)
        .withColumn("recognised", known)
        .withColumn("binding", binding_label(F.col("tier"), F.col("recognised")))
        .drop("_db", "_n1", "_j1", "_t1", "_n2", "_j2")
    )


def court_weight(tier: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in TIER_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, tier), F.lit(TIER_WEIGHT[DEFAULT_TIER]))


# --- search ----------------------------------------------------------------------------------
def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), lambda t: t != "")


def search_index(corpus: DataFrame) -> DataFrame:
    """The positional index of ``doc_id``, ``text``; keep it as a table to search it again."""
    return inverted.build_index(corpus.select("doc_id", _terms(F.col("text")).alias("words")), "doc_id", "words")


def search(index: DataFrame, queries: DataFrame, page: int = SEARCH_PAGE) -> DataFrame:
    """Any-term search ranked by tf-idf; a text that holds a quoted phrase word by word scores double.

    queries: query_id, query. The first ``page`` documents per query.
    """
    quoted = F.transform(F.regexp_extract_all("query", F.lit('"([^"]+)"'), 1), _terms)
    asked = queries.select(
        "query_id", F.array_distinct(_terms(F.regexp_replace("query", '"', " "))).alias("terms"), F.filter(quoted, lambda p: F.size(p) > 0).alias("phrases")
    )
    return inverted.search(index, asked, page).withColumnRenamed("key", "doc_id")


def search_corpus(corpus: DataFrame, queries: DataFrame, page: int = SEARCH_PAGE) -> DataFrame:
    """Index the corpus and search it; the index is written once and read by every step of the search."""
    folder = shared_folder(corpus.sparkSession, "search")
    search_index(corpus).write.parquet(folder)
    return search(corpus.sparkSession.read.parquet(folder), queries, page)


def browse_newest(cases: DataFrame, court: str, date: str, tie: str, page: int = SEARCH_PAGE) -> DataFrame:
    """The newest decisions of each court, the fallback with no relevance signal."""
    newest = Window.partitionBy(court).orderBy(F.desc(date), tie)
    top = cases.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= page)
    return top.withColumn("position", F.col("_n") - 1).drop("_n")


# --- merge and filters -----------------------------------------------------------------------
def citation_year(citation: Column, as_of_year: Column | int) -> Column:
    last = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    y = F.regexp_extract(F.coalesce(citation, F.lit("")), r"^\s*(\d{4})\b", 1).try_cast("int")
    return F.when((y >= 1800) & (y <= last + 1), y)


def effective_year(decision_date: Column, year: Column) -> Column:
    return F.coalesce(F.year(decision_date), year)


def merge_key(citation: Column, database_id: Column, case_id: Column) -> Column:
    folded = F.lower(F.trim(F.regexp_replace(F.coalesce(citation, F.lit("")), r"(?i)\s*\(CanLII\)\s*$", "")))
    return F.coalesce(F.nullif(folded, F.lit("")), F.lower(F.concat(database_id, F.lit("/"), case_id)))


def merge_hits(hits: DataFrame, keep: list[str]) -> DataFrame:
    """One case per request and key: union of angles in order found, best rank, first record.

    hits: request_id, merge_key, angle, query_no, position, keep... Hits meet per angle first, so a
    case returned by everything still shuffles as one row per angle.
    """
    seen = F.struct("query_no", "position")
    per_angle = hits.groupBy("request_id", "merge_key", "angle").agg(
        F.min(seen).alias("_at"), F.min("position").alias("_rank"), F.min_by(F.struct(*keep), seen).alias("_rec"), F.count("*").alias("_n"),
    )
    merged = per_angle.groupBy("request_id", "merge_key").agg(
        F.array_sort(F.collect_list(F.struct("_at", F.col("angle").alias("value")))).alias("_angles"),
        F.min("_rank").alias("best_rank"),
        F.min_by("_rec", "_at").alias("_rec"),
        F.sum("_n").alias("hits"),
    )
    return merged.select(
        "request_id", "merge_key", "_rec.*", F.transform("_angles", lambda s: s["value"]).alias("found_by"), "best_rank", "hits"
    )


def passes_filters(earliest: Column, wanted: Column) -> Column:
    """Hard rules: excluded databases, too old (unknown years pass), federal scope needs a federal court."""
    too_old = F.coalesce(F.col("effective_year") < earliest, F.lit(False))
    foreign = (wanted == "Federal") & (F.col("jurisdiction") != "ca")
    return ~F.col("database_id").isin(*EXCLUDED_DATABASES) & ~too_old & ~foreign


# --- scores ----------------------------------------------------------------------------------
def jurisdiction_score(tier: Column, jurisdiction: Column, wanted: Column) -> Column:
    federal, home = jurisdiction == "ca", jurisdiction == "on"
    return (
        F.when(tier == 1, 1.0)
        .when(wanted == "Ontario", F.when(home, 1.0).when(federal, 0.35).otherwise(0.15))
        .when(wanted == "Federal", F.when(federal, 1.0).otherwise(0.15))
        .otherwise(F.when(home | federal, 1.0).otherwise(0.6))
    )


def recency_score(year: Column, as_of_year: int, span: Column) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year)
    fresh = F.greatest(F.lit(0.0), 1.0 - age / F.greatest(F.lit(1), span))
    return F.when(F.coalesce(year, F.lit(0)) == 0, RECENCY_FLOOR).otherwise(RECENCY_FLOOR + (1 - RECENCY_FLOOR) * fresh)


def stage_one(cases: DataFrame, as_of_year: int) -> DataFrame:
    """Add the five terms and their sum. Needs wanted, span, tier, jurisdiction, effective_year, best_rank, angles."""
    return (
        cases.withColumn("s_court", W_COURT * court_weight(F.col("tier")))
        .withColumn("s_jurisdiction", W_JURISDICTION * jurisdiction_score(F.col("tier"), F.col("jurisdiction"), F.col("wanted")))
        .withColumn("s_angles", W_ANGLES * F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("angles") - 1) / 3.0))
        .withColumn("s_rank", W_RANK * F.greatest(F.lit(0.0), 1.0 - F.col("best_rank") / float(SEARCH_PAGE)))
        .withColumn("s_recency", W_RECENCY * recency_score(F.col("effective_year"), as_of_year, F.col("span")))
        .withColumn("score", F.round(F.col("s_court") + F.col("s_jurisdiction") + F.col("s_angles") + F.col("s_rank") + F.col("s_recency"), 9))
    )


def subject_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z\-']{2,}"), 0)
    stop = F.array(*[F.lit(w) for w in SUBJECT_STOPWORDS])
    return F.array_except(found, stop)


def subject_signal(keywords: Column, topics: Column, concepts: Column) -> Column:
    """Signed evidence: nothing published 0, nothing shared negative, else the shared portion."""
    hay = subject_tokens(F.concat_ws(" ", keywords, topics))
    need = subject_tokens(concepts)
    shared = F.size(F.array_intersect(hay, need))
    portion = F.least(F.lit(1.0), shared / F.least(F.size(need), F.lit(SUBJECT_TERMS)))
    return F.when((F.size(hay) == 0) | (F.size(need) == 0), 0.0).when(shared == 0, -MISMATCH_PENALTY).otherwise(portion)


def enrich_and_rank(
    scored: DataFrame, metadata: DataFrame, requests: DataFrame, as_of_year: int, headroom: int | None = None, cap: int | None = None,
) -> DataFrame:
    """Join metadata, filter again on the real date, re-rank, keep max_cases.

    ``cap`` and ``max_cases + headroom`` bound the cases enriched per request; by default all are.
    scored: output of stage_one. metadata: merge_key, decision_date, keywords, topics.
    requests: request_id, max_cases, concepts, earliest_year.
    """
    first = Window.partitionBy("request_id").orderBy(F.desc("score"), "tier", "citation", "merge_key")
    top = scored
    if cap is not None:
        top = top.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= cap).drop("_r")
    top = top.join(requests.select("request_id", "max_cases", "concepts", "earliest_year"), "request_id")
    if headroom is not None:
        top = top.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= F.col("max_cases") + headroom).drop("_r")
    meta = metadata.select("merge_key", "decision_date", "keywords", "topics", F.lit(True).alias("enriched"))
    rich = top.join(meta, "merge_key", "left").withColumn(
        "effective_year", effective_year(F.col("decision_date"), F.col("effective_year"))
    )
    again = rich.filter(passes_filters(F.col("earliest_year"), F.col("wanted")))
    subject = W_SUBJECT * subject_signal(F.col("keywords"), F.col("topics"), F.col("concepts"))
    final = again.withColumn("s_subject", subject).withColumn("final_score", F.round(F.col("score") + F.col("s_subject"), 9))
    last = Window.partitionBy("request_id").orderBy(
        F.desc("final_score"), "tier", F.desc(F.coalesce("effective_year", F.lit(0))), "citation", "merge_key"
    )
    return final.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= F.col("max_cases"))


# --- ladder ----------------------------------------------------------------------------------
def widen(targeted: DataFrame, broadened: DataFrame, browsed: DataFrame, requests: DataFrame, rows: int | None = None) -> DataFrame:
    """Hits of the stages each request needs: targeted; broadened below eight survivors; browse at none.

    Each hit frame: request_id, merge_key, passes, ... The choice per request comes from counts, so
    all requests run through the same job. ``rows`` is about how many hits there are in all: a task gets a bounded
    number of them whatever the session's partitions.
    """
    spark = requests.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows or 0) // WIDEN_ROWS + 1)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "request_id")

    # Copies of a key matter for the targeted count only: broadened hits are asked whether there is one.
    passing = [dealt(h.filter(F.col("passes") & F.col("merge_key").isNotNull()).select("request_id", "merge_key")) for h in (targeted, broadened)]
    a = passing[0].groupBy("request_id").agg(F.count_distinct("merge_key").alias("_a"))
    b = passing[1].groupBy("request_id").agg(F.count("merge_key").alias("_b"))
    stage = dealt(requests.select("request_id")).join(a, "request_id", "left").join(b, "request_id", "left")
    thin = F.coalesce("_a", F.lit(0)) < BROADEN_BELOW
    none = F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)) == 0
    flags = stage.select("request_id", thin.alias("broadened"), (thin & none).alias("used_browse"))
    steps = [h.withColumn("_step", F.lit(i)) for i, h in enumerate((targeted, broadened, browsed))]
    hits = dealt(steps[0].unionByName(steps[1]).unionByName(steps[2])).join(flags, "request_id")
    wanted = (F.col("_step") == 0) | ((F.col("_step") == 1) & F.col("broadened")) | ((F.col("_step") == 2) & F.col("used_browse"))
    return hits.filter(wanted).drop("_step")


def broaden_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(query, '"', " "), r"\s+", " "))


# --- query hygiene ---------------------------------------------------------------------------
#: What a query must hold for ``scrub_query`` to remove a part of it.
TO_SCRUB = r"[@$]|https?://|www\.|\d{3}"


def scrub_query(query: Column) -> Column:
    """Remove addresses, links, amounts and long digit runs; four-digit years stay; quotes rebalanced."""
    given = F.coalesce(query, F.lit(""))
    q = F.regexp_replace(given, r"\S+@\S+", " ")
    q = F.regexp_replace(q, r"https?://\S+|www\.\S+", " ")
    q = F.regexp_replace(q, r"\$[\d,]+(?:\.\d+)?", " ")

    def keep(token: Column) -> Column:
        bare = F.regexp_replace(token, r"""^["'(),;:.]+|["'(),;:.]+$""", "")
        return ~bare.rlike(r"\d{3,}") | bare.rlike(r"^(1[89]\d{2}|20\d{2})$")

    # Most lines hold nothing to remove; word by word is for the others.
    scrubbed = F.array_join(F.filter(tokens(q), keep), " ")
    out = F.when(given.rlike(TO_SCRUB), scrubbed).otherwise(F.trim(F.regexp_replace(given, r"\s+", " ")))
    odd = (F.length(out) - F.length(F.regexp_replace(out, '"', ""))) % 2 == 1
    return F.when(odd, F.trim(F.regexp_replace(F.regexp_replace(out, '"', " "), r"\s+", " "))).otherwise(out)


def usable_queries(generated: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries, refusals). generated: request_id, query_no, angle, query.

    Scrubbed, at least eight characters, distinct by folded text; with ``most``, the first so many; below three the
    request is refused.
    """
    # Through a generator, so that the filter and the keys don't scrub again.
    scrubbed = F.array(F.struct(scrub_query(F.col("query")).alias("query")))
    clean = inline_rows(generated, ["request_id", "query_no", "angle"], scrubbed, "query").filter(F.length("query") >= MIN_QUERY_CHARS)
    first = clean.groupBy("request_id", F.lower("query").alias("_k")).agg(
        F.min(F.struct("query_no", "angle", "query")).alias("_q")
    )
    turn = F.row_number().over(Window.partitionBy("request_id").orderBy("_q.query_no"))
    first = first.withColumn("_turn", turn)
    kept = (first if most is None else first.filter(F.col("_turn") <= most)).select(
        "request_id", "_q.query_no", F.coalesce(F.nullif(F.col("_q.angle"), F.lit("")), F.lit("unspecified")).alias("angle"), "_q.query"
    )
    counts = generated.select("request_id").distinct().join(
        kept.groupBy("request_id").agg(F.count("*").alias("_n")), "request_id", "left"
    )
    n = F.coalesce("_n", F.lit(0))
    refusals = counts.filter(n < MIN_QUERIES).select("request_id", F.format_string(FEW_QUERIES, n).alias("refusal"))
    return kept.join(refusals.select("request_id"), "request_id", "left_anti"), refusals


# --- notes and funnel ------------------------------------------------------------------------
def fallback_note(keywords: Column, topics: Column, angles: Column) -> Column:
    first = F.trim(F.split_part(keywords, F.lit("|"), F.lit(1)))
    short = F.when(F.length(first) > NOTE_CHARS, F.concat(F.rtrim(F.substring(first, 1, NOTE_CHARS)), F.lit("..."))).otherwise(first)
    found = F.coalesce(F.nullif(angles, F.lit("")), F.lit("the search"))
    return (
        F.when(F.coalesce(keywords, F.lit("")) != "", F.format_string(NOTE_KEYWORDS, short))
        .when(F.coalesce(topics, F.lit("")) != "", F.format_string(NOTE_TOPIC, topics))
        .otherwise(F.format_string(NOTE_ANGLES, found))
    )


def attach_notes(ranked: DataFrame, notes: DataFrame) -> DataFrame:
    """Model note by key, else a note from the metadata, flagged. notes: request_id, merge_key, note."""
    own = fallback_note(F.col("keywords"), F.col("topics"), F.array_join("found_by", ", "))
    return (
        ranked.join(notes, ["request_id", "merge_key"], "left")
        .withColumn("note_is_fallback", F.col("note").isNull())
        .withColumn("note", F.coalesce("note", own))
    )


def note_warnings(noted: DataFrame) -> DataFrame:
    counts = noted.groupBy("request_id").agg(F.count_if("note_is_fallback").alias("_n"))
    return counts.filter(F.col("_n") > 0).select("request_id", F.format_string(NOTE_WARNING, "_n").alias("warning"))


def funnel(queries: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
    """Per request: executed queries, raw hits, unique cases, after filters, enriched, shown."""
    q = queries.groupBy("request_id").agg(F.count("*").alias("queries_executed"))
    h = hits.groupBy("request_id").agg(
        F.count("*").alias("raw_hits"),
        F.count_distinct("merge_key").alias("unique_cases"),
        F.count_distinct(F.when(F.col("passes"), F.col("merge_key"))).alias("after_filters"),
    )
    s = shown.groupBy("request_id").agg(
        F.count_if(F.coalesce("enriched", F.lit(False))).alias("enriched"),
        F.count("*").alias("shown"),
        F.bool_or((F.col("wanted") == "Ontario") & ~F.col("jurisdiction").isin("on", "ca", "")).alias("out_of_jurisdiction"),
    )
    joined = q.join(h, "request_id", "full").join(s, "request_id", "full")
    numbers = ("queries_executed", "raw_hits", "unique_cases", "after_filters", "enriched", "shown")
    return joined.select(
        "request_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        F.coalesce("out_of_jurisdiction", F.lit(False)).alias("out_of_jurisdiction"),
    )


