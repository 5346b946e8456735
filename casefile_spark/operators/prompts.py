"""Requests to prompt tables: validation, file scope, message assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_sorted, strip

# Minimum queryable files of matter-only tasks, whole-matter tasks, task order,
# request types and wording.
MATTER_ONLY_MINIMUM = (("compare_clauses", 2), ("suggest_cases", 1))
WHOLE_MATTER_TASKS = ("compare_clauses", "suggest_cases")
TASK_ORDER = (
    "summarize", "timeline", "find_facts", "find_entities", "compare_clauses",
    "suggest_cases", "draft_memo", "draft_correspondence", "draft_pleading",
)
PLAINTIFF_TYPES = (
    "Statement of Claim (Superior Court of Justice)",
    "Plaintiff's Claim — Form 7A (Small Claims Court)",
)
DEFENDANT_TYPES = (
    "Statement of Defence (Superior Court of Justice)",
    "Defence — Form 9A (Small Claims Court)",
)
PICK_TYPE = "Select a pleading type."
NEED_PARTICULARS = (
    "Plaintiff pleadings require claim particulars (the causes of action being advanced and the relief sought)."
)
NEED_OPPOSING = (
    "To draft a defence, upload the opposing party's pleading and tick the confirmation that the "
    "uploaded PDF is that pleading."
)
SINGLE_FILE = "%s runs across the documents in a matter and is not available for a single uploaded file."
TOO_FEW_FILES = "%s needs at least %d ingested files in this matter; this matter has %d."
CHOOSE_FILE = "Please choose a file, or select all files."
BAD_CHOICE = "Please choose a file to query."
BAD_SELECTION = "Invalid file selection."
NOT_IN_MATTER = "File %d does not belong to matter %d."
NOT_SEARCHABLE = "%s cannot be searched (status: %s)."
NOT_SEARCHABLE_ONE = NOT_SEARCHABLE + " Re-process it from the file list above."
MANIFEST_HEAD = (
    "FILE MANIFEST\n\nEvery document listed below was searched for the requested clause. The "
    "comparison table must contain one column for each of them, in this order:\n"
)
NO_PASSAGES = (
    "(no passages relevant to the requested clause were retrieved from this document)"
)


# --- inputs ----------------------------------------------------------------------------------
# A request carries ``inputs``: array<struct<name, label, required, control, values array<string>>>
# in the order the template declares them.
def _supplied(inputs: Column) -> Column:
    filled = F.filter(inputs, lambda i: ~i["control"] & (F.size(F.coalesce(i["values"], F.array().cast("array<string>"))) > 0))
    return F.filter(filled, lambda i: F.array_join(i["values"], "") != "")


def retrieval_text(seed: Column, label: Column, inputs: Column) -> Column:
    """Seed text and every content input, falling back to the task label."""
    given = F.transform(_supplied(inputs), lambda i: F.array_join(i["values"], " "))
    parts = F.filter(F.concat(F.array(F.coalesce(seed, F.lit(""))), given), lambda p: p != "")
    return F.coalesce(F.nullif(F.trim(F.array_join(parts, " ")), F.lit("")), label)


def request_section(label: Column, inputs: Column) -> Column:
    lines = F.transform(_supplied(inputs), lambda i: F.concat(i["label"], F.lit(": "), F.array_join(i["values"], ", ")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Task: "), label)), lines), "\n")


def missing_required(inputs: Column) -> Column:
    """Labels of required inputs that are absent or empty."""
    def empty(i: Column) -> Column:
        v = F.coalesce(i["values"], F.array().cast("array<string>"))
        return (F.size(v) == 0) | ((F.size(v) == 1) & (F.coalesce(v[0], F.lit("")) == ""))

    return F.transform(F.filter(inputs, lambda i: i["required"] & empty(i)), lambda i: i["label"])


def clamp_int(value: Column, default: int, low: int, high: int) -> Column:
    n = F.trim(value.cast("string")).try_cast("int")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def party_role(request_type: Column) -> Column:
    return F.when(request_type.isin(*DEFENDANT_TYPES), "Defendant").otherwise("Plaintiff")


def pleading_errors(request_type: Column, particulars: Column, opposing_confirmed: Column) -> Column:
    kind = F.coalesce(request_type, F.lit(""))
    known = kind.isin(*PLAINTIFF_TYPES, *DEFENDANT_TYPES)
    rules = F.array(
        F.when(~known, PICK_TYPE),
        F.when(kind.isin(*PLAINTIFF_TYPES) & (F.coalesce(particulars, F.lit("")) == ""), NEED_PARTICULARS),
        F.when(kind.isin(*DEFENDANT_TYPES) & ~F.coalesce(opposing_confirmed, F.lit(False)), NEED_OPPOSING),
    )
    return F.array_compact(rules)


# --- availability and scope ------------------------------------------------------------------
def task_refusal(task: Column, label: Column, queryable_files: Column) -> Column:
    """Why a task cannot run with this many searchable files (NULL count: one uploaded file)."""
    minimum = F.lit(None).cast("int")
    for name, least in reversed(MATTER_ONLY_MINIMUM):
        minimum = F.when(task == name, least).otherwise(minimum)
    return (
        F.when(minimum.isNull(), None)
        .when(queryable_files.isNull(), F.format_string(SINGLE_FILE, label))
        .when(queryable_files < minimum, F.format_string(TOO_FEW_FILES, label, minimum, queryable_files))
    )


def task_position(task: Column) -> Column:
    """Display position; unlisted tasks follow, by name."""
    at = F.array_position(F.array(*[F.lit(t) for t in TASK_ORDER]), task)
    return F.when(at > 0, at).otherwise(len(TASK_ORDER) + 1)


def task_availability(matters: DataFrame, files: DataFrame, templates: DataFrame) -> DataFrame:
    """Every task of every matter with its refusal, from live searchable file counts.

    templates: task, label. The result has a row for every matter and task; the tasks, which the result repeats for every
    matter, are gathered in one row and met by a key that all matters have, so nothing passes through the driver.
    """
    live = files.filter(F.col("deleted_at").isNull() & F.col("queryable"))
    counts = live.groupBy("matter_id").agg(F.count("*").cast("int").alias("_n"))
    listed = templates.agg(F.collect_list(F.struct("task", "label")).alias("_tasks")).withColumn("_all", F.lit(True))
    return (
        matters.select("matter_id").join(counts, "matter_id", "left").withColumn("_all", F.lit(True))
        .join(listed, "_all")
        .withColumn("queryable_files", F.coalesce("_n", F.lit(0)))
        .select("matter_id", "queryable_files", F.inline("_tasks"))
        .withColumn("position", task_position(F.col("task")))
        .withColumn("refusal", task_refusal(F.col("task"), F.col("label"), F.col("queryable_files")))
        .withColumn("available", F.col("refusal").isNull())
    )


#: Picks that name no file would all meet under one null key; they are dealt over this many.
NULL_KEYS = 1024
#: Picks a task judges at most about, whatever their number; requests meet their picks in as many tasks as that takes.
PICK_ROWS = 500_000
#: What is wrong with a pick, in order of precedence.
EMPTY, NO_ID, FOREIGN, UNSEARCHABLE = range(4)


def scope_parts(requests: DataFrame, picks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict per request, requests that take their whole matter, accepted files of the others).

    The second has ``request_id``, ``matter_id``: requests of one matter share its files, so none is repeated for each.
    Otherwise as ``resolve_scope``. Picks carry numbers alone through joins and aggregates; the wording, with a file's
    name and label, is put together for the one offending pick of a request.
    """
    mode = F.coalesce(F.nullif(F.trim("scope_mode"), F.lit("")), F.lit("all"))
    mode = F.when((mode == "single") & F.col("task").isin(*WHOLE_MATTER_TASKS), "all").otherwise(mode)
    req = requests.withColumn("mode", mode)
    raw = F.trim("file_id")
    asked = picks.select("request_id", "pick_no", raw.try_cast("long").alias("_id"), (raw == "").alias("_empty"))
    wanted = asked.join(
        req.filter(F.col("mode").isin("selected", "single")).select("request_id", "matter_id", (F.col("mode") == "single").alias("_single")), "request_id"
    ).withColumn("_deal", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("request_id", "pick_no"), F.lit(NULL_KEYS))).otherwise(F.lit(0)))
    known = files.select(F.col("file_id").alias("_id"), F.col("matter_id").alias("_m"), "queryable", F.lit(0).cast("long").alias("_deal"))
    checked = wanted.join(known, ["_id", "_deal"], "left").withColumn(
        "_fault",
        F.when(F.col("_single") & F.col("_empty"), EMPTY)
        .when(F.col("_id").isNull(), NO_ID)
        .when(~F.col("_m").eqNullSafe(F.col("matter_id")), FOREIGN)
        .when(~F.col("queryable"), UNSEARCHABLE),
    )
    tasks = max(int(picks.sparkSession.conf.get("spark.sql.shuffle.partitions")), picks.count() // PICK_ROWS + 1)
    checked = checked.repartition(tasks, "request_id")
    at = F.when(F.col("_fault").isNotNull(), F.col("pick_no"))
    per_request = checked.groupBy("request_id").agg(
        F.min_by("_fault", at).alias("_fault"), F.min_by("_id", at).alias("_id"), F.min_by("matter_id", at).alias("_matter"), F.min_by("_single", at).alias("_single"), F.count("*").alias("_picks")
    )
    # Names are looked up for the requests that fail by one alone.
    named = files.filter(~F.col("queryable")).groupBy(F.col("file_id").alias("_id"), F.col("matter_id").alias("_matter")).agg(F.min(F.struct("filename", "label")).alias("_file"))
    by_name = F.struct(F.lit(UNSEARCHABLE).alias("_fault"), "_id", "_matter")
    failed = per_request.join(named.select(by_name.alias("_at"), "_file"), F.struct("_fault", "_id", "_matter").eqNullSafe(F.col("_at")), "left")
    unsearchable = [F.format_string(wording, "_file.filename", "_file.label") for wording in (NOT_SEARCHABLE_ONE, NOT_SEARCHABLE)]
    fault = F.col("_fault")
    told = failed.select(
        "request_id", "_picks",
        F.when(fault == EMPTY, CHOOSE_FILE)
        .when(fault == NO_ID, F.when(F.col("_single"), BAD_CHOICE).otherwise(BAD_SELECTION))
        .when(fault == FOREIGN, F.format_string(NOT_IN_MATTER, "_id", "_matter"))
        .when(fault == UNSEARCHABLE, F.when(F.col("_single"), unsearchable[0]).otherwise(unsearchable[1])).alias("_refusal"),
    )
    refusal = F.when((F.col("mode") == "single") & F.col("_picks").isNull(), CHOOSE_FILE).otherwise(F.col("_refusal"))
    verdict = (
        req.join(told, "request_id", "left")
        .withColumn("refusal", refusal)
        .withColumn("takes_all", (F.col("mode") == "all") | ((F.col("mode") == "selected") & F.col("_picks").isNull()))
        .select("request_id", "matter_id", "mode", "refusal", "takes_all")
    )
    fine = verdict.filter(F.col("refusal").isNull())
    chosen = (
        checked.join(fine.filter(~F.col("takes_all")).select("request_id"), "request_id", "left_semi")
        .select("request_id", "matter_id", F.col("_id").alias("file_id"))
        .distinct()
    )
    return verdict, fine.filter("takes_all").select("request_id", "matter_id"), chosen


def resolve_scope(requests: DataFrame, picks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict per request, accepted files per request).

    requests: request_id, matter_id, task, scope_mode. picks: request_id, pick_no, file_id string.
    files: file_id, matter_id, filename, queryable, label. The first offending pick gives the refusal;
    an empty selection means all files; whole-matter tasks treat single as all.
    """
    verdict, whole, chosen = scope_parts(requests, picks, files)
    everything = whole.join(files.filter("queryable").select("matter_id", "file_id"), "matter_id")
    return verdict, everything.select("request_id", "matter_id", "file_id").unionByName(chosen)


def scope_totals(whole: DataFrame, chosen: DataFrame, files: DataFrame) -> DataFrame:
    """``request_id``, ``files``, ``id_sum`` of the accepted files; a matter's files are counted once for all its requests."""
    totals = [F.count("*").alias("files"), F.sum("file_id").alias("id_sum")]
    matters = files.filter("queryable").groupBy("matter_id").agg(*totals)
    rows = whole.join(matters, "matter_id").select("request_id", "files", "id_sum").unionByName(chosen.groupBy("request_id").agg(*totals))
    return rows.groupBy("request_id").agg(F.sum("files").alias("files"), F.sum("id_sum").alias("id_sum"))


# --- messages --------------------------------------------------------------------------------
def passage_block() -> Column:
    return F.concat(
        F.lit("[SOURCE: "), F.col("source"), F.lit(" "), F.col("locator"), F.lit("]\n"), F.col("text"), F.lit("\n")
    )


def context_message(passages: DataFrame, requests: DataFrame) -> DataFrame:
    """CONTEXT in rank order, then REQUEST. requests: query_id, request_text."""
    blocks = passages.groupBy("query_id").agg(
        join_sorted(F.collect_list(F.struct("rank", passage_block().alias("value"))), "\n").alias("_c")
    )
    return requests.join(blocks, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("CONTEXT:\n\n"), F.coalesce(F.concat("_c", F.lit("\n")), F.lit("")), F.lit("REQUEST:\n"), F.col("request_text")
        ).alias("message"),
    )


def comparison_message(per_file: DataFrame, requests: DataFrame) -> DataFrame:
    """Manifest with passage counts, passages per document, then REQUEST.

    per_file: query_id, collection_pos, source, rank (NULL: nothing found), locator, text.
    """
    passage = F.when(F.col("rank").isNotNull(), F.struct("rank", passage_block().alias("value")))
    docs = per_file.groupBy("query_id", "collection_pos", "source").agg(
        F.count("rank").alias("_n"), F.collect_list(passage).alias("_p")
    )
    note = F.when(F.col("_n") > 0, F.concat(F.col("_n").cast("string"), F.lit(" passage(s) retrieved"))).otherwise(
        F.lit("NO passages retrieved")
    )
    body = F.when(F.col("_n") > 0, join_sorted(F.col("_p"), "\n")).otherwise(F.lit(NO_PASSAGES + "\n"))
    section = F.concat(F.lit("=== DOCUMENT: "), F.col("source"), F.lit(" ===\n\n"), body)
    folded = (
        docs.select("query_id", F.struct("collection_pos", "source", note.alias("note"), section.alias("section")).alias("_d"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list("_d")).alias("_d"))
    )
    listing = F.array_join(
        F.transform("_d", lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d["source"], F.lit(" - "), d["note"])), "\n"
    )
    sections = F.array_join(F.transform("_d", lambda d: d["section"]), "\n")
    return folded.join(requests, "query_id").select(
        "query_id",
        F.concat(
            F.lit(MANIFEST_HEAD), listing, F.lit("\n\nCONTEXT:\n\n"), sections, F.lit("\nREQUEST:\n"), F.col("request_text")
        ).alias("message"),
    )


def system_prompts(requests: DataFrame, templates: DataFrame, texts: dict[str, str]) -> DataFrame:
    """System prompt per request from the wording held in the templates table.

    requests: request_id, task, variant_key, cross_document, authority, detail_level, mode.
    templates: task, body, variants map<string,string>. texts holds the code-owned wording: preamble,
    matter_preamble, matter_note, authority, detailed, and exhaustive_<task>.
    """
    def text(name: str) -> Column:
        return F.lit(texts.get(name, ""))

    exhaustive = is_exhaustive(F.col("detail_level"), F.col("mode"))
    variant = F.when(F.col("variants").isNotNull(), F.try_element_at("variants", F.col("variant_key")))
    broken = F.col("variants").isNotNull() & F.coalesce(variant, F.lit("")).eqNullSafe(F.lit(""))
    by_task = F.lit(None).cast("string")
    for task in ("timeline", "summarize", "find_entities"):
        by_task = F.when(F.col("task") == task, text(f"exhaustive_{task}")).otherwise(by_task)
    parts = F.array(
        F.when(F.col("cross_document"), text("matter_preamble")).otherwise(text("preamble")),
        F.when(F.col("cross_document"), text("matter_note")),
        strip(F.col("body")),
        strip(variant),
        F.when(F.col("authority"), text("authority")),
        F.when(F.col("detail_level") == "Detailed", text("detailed")),
        F.when(exhaustive, by_task),
    )
    joined = requests.join(templates, "task", "left")
    error = F.when(F.col("body").isNull(), F.concat(F.lit("Unknown task: "), F.col("task"))).when(
        broken, F.concat(F.lit("Task '"), F.col("task"), F.lit("' requires a valid pleading_type"))
    )
    return joined.select(
        "request_id",
        F.when(error.isNull(), F.array_join(F.array_compact(parts), "\n\n")).alias("system_prompt"),
        error.alias("error"),
    )


def is_exhaustive(detail_level: Column, mode: Column) -> Column:
    def starts(c: Column) -> Column:
        return F.coalesce(c, F.lit("")).startswith("Exhaustive")

    return starts(detail_level) | starts(mode)
