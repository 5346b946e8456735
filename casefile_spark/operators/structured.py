"""Completions to typed tables: parse, coerce, reconcile, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generate import explode_rows
from ..functions.text import collapse_key, join_sorted, squeeze, strip

# Block pattern, schemas, date layouts, hedge words, table headers and wording.
JSON_BLOCK = r"(?is)```json\s*\n(.*?)\n```"
STRUCTURED_TASKS = ("timeline", "find_entities", "compare_clauses")
SCHEMAS = {
    "timeline": "events array<struct<date string, date_iso string, event string, source string, significance string>>",
    "find_entities": (
        "categories array<struct<name string, note string, rows array<struct<entity string, count int, source string>>>>"
    ),
    "compare_clauses": "files array<string>, rows array<struct<attribute string, cells array<string>>>",
}
DATE_LAYOUTS = ("yyyy-M-d", "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy")
HEDGES = r"(?i)\b(or about|circa|approx|unclear|ambiguous|unknown)\b"
TIMELINE_HEADERS = ("Date", "Event", "Source", "Significance")
ENTITY_HEADERS = ("Entity", "Count", "Source")
ABSENT_CELLS = ("", "-", "—")
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|?[\s:\-|]+\|[\s:\-|]*$"
HEADING = r"^\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$"
RECONCILE = (
    "Export note: the %s table on screen has %d row(s) but the structured export data has %d. The exported "
    "file follows the structured data. Verify against the source before relying on the export."
)
NO_BLOCK = (
    "This result carried no valid structured export data, so a spreadsheet export falls back to reading "
    "the table out of the answer text. Check the exported file against the answer."
)
NOT_VALID = (
    "The structured export data for this result did not validate, so a spreadsheet export falls back to "
    "reading the table out of the answer text. Check the exported file against the answer."
)
RAGGED = (
    "%d row(s) in the source table did not match the column count and are shown as parsed — verify "
    "against the answer."
)


# --- the JSON block --------------------------------------------------------------------------
def split_block(completions: DataFrame) -> DataFrame:
    """Take the last fenced JSON block out of the answer, valid or not. Adds payload and answer_text."""
    payload = F.try_element_at(F.regexp_extract_all("answer", F.lit(JSON_BLOCK), 1), F.lit(-1))
    whole = F.try_element_at(F.regexp_extract_all("answer", F.lit(JSON_BLOCK), 0), F.lit(-1))
    pieces = F.split("answer", JSON_BLOCK, -1)
    tail = F.length(F.element_at(pieces, -1))
    start = F.length("answer") - tail - F.length(whole)
    rest = F.concat(F.substring("answer", F.lit(1), start), F.substring("answer", start + F.length(whole) + 1, tail))
    tabular = F.col("task").isin(*STRUCTURED_TASKS)
    return completions.select(
        "*",
        F.when(tabular, payload).alias("payload"),
        F.when(tabular & payload.isNotNull(), strip(rest)).when(tabular, strip(F.col("answer"))).otherwise(
            strip(F.col("answer"))
        ).alias("answer_text"),
    )


def _parsed(split: DataFrame, task: str) -> DataFrame:
    """Parse the payload; ``_broken`` unless it is exactly one JSON object of the expected types."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    one_value = F.json_array_length(F.concat(F.lit("["), F.col("payload"), F.lit("]"))) == 1
    an_object = strip(F.col("payload")).startswith("{") & F.coalesce(one_value, F.lit(False))
    return (
        split.filter(F.col("task") == task)
        .withColumn("_p", F.from_json("payload", SCHEMAS[task] + ", _bad string", opts))
        .withColumn("_broken", ~F.coalesce(an_object, F.lit(False)) | F.col("_p").isNull() | F.col("_p._bad").isNotNull())
    )


def _reason(valid: Column) -> Column:
    return F.when(F.col("_broken"), NO_BLOCK).when(~F.coalesce(valid, F.lit(False)), NOT_VALID)


def parse_timeline(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): result_id, row_no, date, date_iso, event, source, significance."""
    df = _parsed(split, "timeline")
    ok = F.col("_p.events").isNotNull() & F.forall("_p.events", lambda e: e["date"].isNotNull() & e["event"].isNotNull())
    df = df.withColumn("reason", _reason(ok))
    e = F.col("_e")
    rows = (
        df.filter(F.col("reason").isNull())
        .select("result_id", F.posexplode("_p.events").alias("row_no", "_e"))
        .select(
            "result_id", "row_no", e["date"].alias("date"),
            F.coalesce(complete_date(e["date_iso"]), complete_date(e["date"])).alias("date_iso"),
            e["event"].alias("event"),
            F.coalesce(e["source"], F.lit("")).alias("source"),
            F.coalesce(e["significance"], F.lit("")).alias("significance"),
        )
    )
    return rows, _quarantine(df)


def parse_entities(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories with rows, quarantine); a category without rows keeps one row with its note."""
    df = _parsed(split, "find_entities")
    ok = F.col("_p.categories").isNotNull() & F.forall(
        "_p.categories",
        lambda c: c["name"].isNotNull()
        & F.forall(F.coalesce(c["rows"], F.array()), lambda r: r["entity"].isNotNull()),
    )
    df = df.withColumn("reason", _reason(ok))
    cats = df.filter(F.col("reason").isNull()).select(
        "result_id", F.posexplode("_p.categories").alias("category_no", "_c")
    )
    rows = cats.select(
        "result_id", "category_no", F.col("_c.name").alias("category"),
        F.coalesce("_c.note", F.lit("")).alias("note"), F.posexplode_outer("_c.rows").alias("row_no", "_r"),
    )
    return rows.select(
        "result_id", "category_no", "category", "note", "row_no",
        F.col("_r.entity").alias("entity"), F.col("_r.count").alias("count"),
        F.when(F.col("_r").isNotNull(), F.coalesce("_r.source", F.lit(""))).alias("source"),
    ), _quarantine(df)


def parse_comparison(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, quarantine): one row per attribute and file, ragged rows squared off first."""
    df = _parsed(split, "compare_clauses")
    ok = F.col("_p.files").isNotNull() & F.forall(
        F.coalesce("_p.rows", F.array()), lambda r: r["attribute"].isNotNull()
    )
    df = df.withColumn("reason", _reason(ok))
    rows = df.filter(F.col("reason").isNull()).select(
        "result_id", F.col("_p.files").alias("files"), F.posexplode("_p.rows").alias("row_no", "_r")
    )
    square = square_cells(F.col("_r.cells"), F.size("files"))
    return (
        rows.select("result_id", "row_no", F.col("_r.attribute").alias("attribute"), "files", square.alias("cells"))
        .select("result_id", "row_no", "attribute", F.posexplode(F.arrays_zip("files", "cells")).alias("file_no", "_z"))
        .select("result_id", "row_no", "attribute", "file_no", F.col("_z.files").alias("file"), F.col("_z.cells").alias("cell"))
    ), _quarantine(df)


def _quarantine(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull()).select("result_id", "task", "reason", "payload")


def square_cells(cells: Column, n: Column) -> Column:
    """Pad with '' or cut to exactly n cells, so a column never shifts."""
    padded = F.concat(F.coalesce(cells, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n))
    return F.when(n > 0, F.slice(padded, 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def complete_date(value: Column) -> Column:
    """ISO date only for a complete, unhedged date; anything else NULL."""
    v = squeeze(value)
    # Month names parse in title case only, so the words are brought there first.
    shaped = F.initcap(v)
    shapes = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2} [a-z]+ \d{4}$", r"^[a-z]+ \d{1,2}, \d{4}$", r"^\d{1,2} [a-z]+ \d{4}$", r"^[a-z]+ \d{1,2}, \d{4}$")
    tries = [
        F.when(F.lower(v).rlike(shape), F.to_date(F.try_to_timestamp(shaped, F.lit(layout))))
        for shape, layout in zip(shapes, DATE_LAYOUTS)
    ]
    return F.when((v != "") & ~v.rlike(HEDGES), F.date_format(F.coalesce(*tries), "yyyy-MM-dd"))


# --- markdown --------------------------------------------------------------------------------
def answer_lines(split: DataFrame, text: str = "answer_text") -> DataFrame:
    return explode_rows(split, ["result_id"], F.split(text, r"\r\n|\r|\n", -1), "line", "line_no")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Data rows per result, over all its pipe tables, however long."""
    tables, _ = markdown_tables(lines)
    counted = tables.groupBy("result_id").agg(F.sum("rows").alias("n"))
    return lines.select("result_id").distinct().join(counted, "result_id", "left").select(
        "result_id", F.coalesce("n", F.lit(0)).alias("markdown_rows")
    )


def reconcile(structured: DataFrame, markdown: DataFrame) -> DataFrame:
    """structured: result_id, kind, structured_rows. A note only when the table on screen has rows."""
    m = F.coalesce("markdown_rows", F.lit(0))
    differs = (m > 0) & (m != F.col("structured_rows"))
    return structured.join(markdown, "result_id", "left").select(
        "result_id", "kind", "structured_rows", m.alias("markdown_rows"),
        F.when(differs, F.format_string(RECONCILE, "kind", m, "structured_rows")).alias("warning"),
    )


def _cells_of(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: strip(c))


def markdown_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pipe tables as (tables, rows).

    tables: result_id, table_no, title (nearest heading above), headers, rows, note.
    rows: result_id, table_no, row_no, cells - squared off to the header width.
    """
    # A window per result is bounded by the one row its lines came from.
    page = Window.partitionBy("result_id").orderBy("line_no")
    upto = page.rowsBetween(Window.unboundedPreceding, 0)
    pipe = strip(F.col("line")).startswith("|")
    headline = F.when(F.col("line").rlike(HEADING), F.trim(F.regexp_extract("line", HEADING, 1)))
    df = lines.withColumn("_pipe", pipe).select(
        "*",
        F.last(headline, ignorenulls=True).over(upto).alias("_head"),
        F.lag("_pipe").over(page).alias("_pipe_above"),
        F.lag("line").over(page).alias("_above"),
    )
    turns = F.when(F.col("_pipe").eqNullSafe(F.col("_pipe_above")), 0).otherwise(1)
    df = df.withColumn("_island", F.sum(turns).over(upto))
    # A rule line right under a pipe line with at least one more pipe opens a table.
    header_like = F.col("_pipe_above") & F.expr("substring(trim(_above), 2)").contains("|")
    opens = F.col("_pipe") & F.col("line").rlike(TABLE_RULE) & header_like
    first = Window.partitionBy("result_id", "_island")
    df = df.withColumn("_rule", F.min(F.when(opens, F.col("line_no"))).over(first)).filter("_pipe")
    rules = df.filter(F.col("line_no") == F.col("_rule")).select(
        "result_id", "_island", "_rule", F.col("_head").alias("title"), _cells_of(F.col("_above")).alias("headers"),
        F.row_number().over(page).alias("table_no"),
    )
    body = (
        df.drop("_rule").join(rules, ["result_id", "_island"])
        .filter(F.col("line_no") > F.col("_rule"))
        .withColumn("_raw", _cells_of(F.col("line")))
    )
    rows = body.select(
        "result_id", "table_no", (F.col("line_no") - F.col("_rule")).alias("row_no"),
        (F.size("_raw") != F.size("headers")).alias("ragged"), square_cells(F.col("_raw"), F.size("headers")).alias("cells"),
    )
    counts = rows.groupBy("result_id", "table_no").agg(F.count("*").alias("rows"), F.count_if("ragged").alias("_r"))
    tables = rules.join(counts, ["result_id", "table_no"], "left").select(
        "result_id", "table_no", "title", "headers", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.when(F.col("_r") > 0, F.format_string(RAGGED, "_r")).otherwise("").alias("note"),
    )
    return tables, rows


# --- export tables ---------------------------------------------------------------------------
def _structured_cells(split: DataFrame) -> DataFrame:
    timeline, _ = parse_timeline(split)
    entities, _ = parse_entities(split)
    comparison, _ = parse_comparison(split)
    t = timeline.select(
        "result_id", F.lit(1).alias("table_no"), F.lit("Timeline").alias("table_title"), F.lit("").alias("note"),
        F.array(*map(F.lit, TIMELINE_HEADERS)).alias("headers"), F.col("row_no").cast("long").alias("row_no"),
        F.array("date", "event", "source", "significance").alias("cells"), F.col("date_iso").alias("date_value"),
    )
    shown = F.array("entity", F.coalesce(F.col("count").cast("string"), F.lit("")), "source")
    e = entities.select(
        "result_id", (F.col("category_no") + 1).alias("table_no"), F.col("category").alias("table_title"), "note",
        F.array(*map(F.lit, ENTITY_HEADERS)).alias("headers"), F.col("row_no").cast("long").alias("row_no"),
        F.when(F.col("entity").isNotNull(), shown).alias("cells"), F.lit(None).cast("string").alias("date_value"),
    )
    wide = comparison.groupBy("result_id", "row_no", "attribute").agg(
        F.array_sort(F.collect_list(F.struct("file_no", "file", "cell"))).alias("_c")
    )
    c = wide.select(
        "result_id", F.lit(1).alias("table_no"), F.lit("Clause comparison").alias("table_title"), F.lit("").alias("note"),
        F.concat(F.array(F.lit("Attribute")), F.transform("_c", lambda s: s["file"])).alias("headers"),
        F.col("row_no").cast("long").alias("row_no"),
        F.concat(F.array("attribute"), F.transform("_c", lambda s: s["cell"])).alias("cells"),
        F.lit(None).cast("string").alias("date_value"),
    )
    return t.unionByName(e).unionByName(c).withColumn("structured", F.lit(True))


def export_tables(split: DataFrame) -> DataFrame:
    """Structured tables first; results without any fall back to the markdown tables, flagged as such."""
    tabular = split.filter(F.col("task").isin(*STRUCTURED_TASKS))
    first = _structured_cells(tabular)
    rest = tabular.join(first.select("result_id").distinct(), "result_id", "left_anti")
    tables, rows = markdown_tables(answer_lines(rest))
    default = F.when(F.col("task") == "timeline", "Timeline").when(F.col("task") == "compare_clauses", "Clause comparison")
    fallback = (
        tables.withColumnRenamed("rows", "_n")
        .join(rows.select("result_id", "table_no", F.col("row_no").cast("long").alias("row_no"), "cells"), ["result_id", "table_no"], "left")
        .join(rest.select("result_id", "task"), "result_id")
        .select(
            "result_id", F.col("table_no").cast("int").alias("table_no"),
            F.coalesce(F.nullif(F.col("title"), F.lit("")), default).alias("table_title"),
            "note", "headers", "row_no", "cells", F.lit(None).cast("string").alias("date_value"),
            F.lit(False).alias("structured"),
        )
    )
    both = first.withColumn("table_no", F.col("table_no").cast("int")).unionByName(fallback)
    return both.join(tabular.select("result_id", "task"), "result_id")


def comparison_pivot(cells: DataFrame, files: list[str]) -> DataFrame:
    """Attributes down, the given files across."""
    return cells.groupBy("attribute").pivot("file", files).agg(F.first("cell", ignorenulls=True))


def absent_files(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose every cell says the clause is not there."""
    v = F.lower(strip(F.coalesce("cell", F.lit(""))))
    nothing = v.startswith("not present") | v.isin(*ABSENT_CELLS)
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.bool_and(nothing).alias("absent"))


def entity_rollup(rows: DataFrame) -> DataFrame:
    """Entities and mentions per category; an empty category keeps its note."""
    return rows.groupBy("result_id", "category_no", "category", "note").agg(
        F.count("entity").alias("entities"), F.sum(F.coalesce("count", F.lit(0))).alias("mentions")
    )


# --- exact collapse --------------------------------------------------------------------------
def collapse_within(rows: DataFrame, scope: list[str], key_fields: list[str], order: str, source: str) -> DataFrame:
    """Collapse exact repeats inside each scope (one file), never across.

    The first row survives; distinct sources are appended in order of appearance; ``repeats`` is how
    many rows were folded into it. Copies meet in a pre-aggregation by source, so a line repeated a
    billion times reaches its final group as one row per source.
    """
    keys = [f"_k{i}" for i in range(len(key_fields))]
    keyed = rows
    for k, f in zip(keys, key_fields):
        keyed = keyed.withColumn(k, collapse_key(F.col(f)))
    rest = [c for c in rows.columns if c not in (*scope, order, source)]
    by_source = keyed.groupBy(*scope, *keys, source).agg(
        F.min(F.struct(order, *rest)).alias("_row"), F.count("*").alias("_n")
    )
    named = F.when(F.coalesce(F.col(source), F.lit("")) != "", F.struct(F.col(f"_row.{order}"), F.col(source).alias("value")))
    merged = by_source.groupBy(*scope, *keys).agg(
        F.min("_row").alias("_row"), (F.sum("_n") - 1).alias("repeats"), F.collect_list(named).alias("_s")
    )
    return merged.select(
        *scope, F.col(f"_row.{order}").alias(order), *[F.col(f"_row.{c}").alias(c) for c in rest],
        join_sorted(F.col("_s"), "; ").alias(source), "repeats",
    )


def collapse_count(collapsed: DataFrame, keys: list[str]) -> DataFrame:
    return collapsed.groupBy(*keys).agg(F.count("*").alias("rows_kept"), F.sum("repeats").alias("rows_collapsed"))
