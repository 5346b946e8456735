"""Text to citable chunks: overlapping windows, sections, tables and sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import SEGMENT_ROWS, next_fit, pack_short
from ..functions.generate import explode_rows, inline_rows
from ..functions.segments import Running, block_of, islands, one_segment, running, segmented
from ..functions.text import WINDOW_OVERLAP, WINDOW_TOKENS, let, token_count, token_windows, tokens

# Fixed values of headings, table labels, header search and sheet locators.
MAX_HEADING_DEPTH = 3
CAPTION_CELL_CHARS = 40
CAPTION_CHARS = 48
HEADER_SCAN_ROWS = 10
HEADER_LABEL_CHARS = 28
HEADER_MIN_CELLS = 3
LOCATOR_COLUMNS = 5


# --- windows ---------------------------------------------------------------------------------
def window_chunks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per overlapping window: keep..., window_no (from 0), windows, text."""
    cut = df.select(*keep, tokens(F.col(text)).alias("_tok")).select(*keep, token_windows(F.col("_tok")).alias("_w"))
    rows = explode_rows(cut, [*keep, F.size("_w").alias("windows")], F.col("_w"), "text", "window_no")
    return rows.select(*keep, "window_no", "windows", "text")


def page_chunks(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Windows that never cross a page; keep must hold page_no and is_ocr."""
    locator = F.concat(F.lit("p."), F.col("page_no"), F.when(F.col("is_ocr"), F.lit(" (OCR)")).otherwise(F.lit("")))
    return window_chunks(pages, "text", keep).withColumn("locator", locator)


def message_chunks(messages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Windows over a message body; every window keeps the message's locator."""
    return window_chunks(messages, text, keep)


def chunk_id(sha: Column, index: Column, text: Column) -> Column:
    """Same content, position and opening text give the same id on any machine."""
    return F.sha2(F.concat(sha, index.cast("string"), F.substring(text, 1, 200)), 256)


# --- headings and sections -------------------------------------------------------------------
def heading_level(style: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(style, F.lit(""))))
    digits = F.regexp_extract(s, r"^heading\s*(\d+)$", 1)
    return F.when(s == "title", 1).otherwise(digits.try_cast("int"))


def heading_paths(blocks: DataFrame, rows_per_segment: int = 100_000) -> DataFrame:
    """Add level, para_no and heading_path to blocks(file_id, seq, kind, style, text).

    The depth of the i-th heading is i + min(0, min over earlier j of (level_j - j)): a heading can
    open at most one level below its predecessor, and levels beyond the third reuse the third slot.
    Both that minimum and "the last heading at each depth" are running values, so a document of any
    length is handled without folding it row by row. Where no document is longer than a segment, they
    are windows over one shuffle and one sort.
    """
    out = blocks.withColumn("level", _block_level())
    if one_segment(blocks, "seq", rows_per_segment):
        return _short_paths(out).select(*out.columns, "para_no", "heading_path")
    return _long_paths(out, rows_per_segment)


def _block_level() -> Column:
    return F.when((F.col("kind") == "para") & (F.trim(F.coalesce("text", F.lit(""))) != ""), heading_level(F.col("style")))


def _path(last: Callable[[int], Column]) -> Column:
    """Headings in force, from the last heading (seq, text) at each depth: a slot counts only while no shallower one came after it."""
    slots, after = [], F.lit(-1).cast("long")
    for d in range(1, MAX_HEADING_DEPTH + 1):
        at = last(d)["seq"].cast("long")
        slots.append(F.when(at > after, last(d)["text"]))
        after = F.greatest(after, F.coalesce(at, F.lit(-1).cast("long")))
    return F.array_compact(F.array(*slots))


def _short_paths(df: DataFrame) -> DataFrame:
    """Paths of documents that each lie in one segment; the heading's text is cut before the shuffle, so that a caller without use for ``text`` shuffles none."""
    upto = Window.partitionBy("file_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    headed = F.col("level").isNotNull()
    df = df.withColumn("_here", F.when(headed, F.struct("seq", F.trim("text").alias("text")))).repartition("file_id")
    df = df.withColumn("_i", F.count("level").over(upto)).withColumn("para_no", F.sum(F.when(F.col("kind") == "para", 1).otherwise(0)).over(upto))
    slack = F.when(headed, F.least("level", F.lit(MAX_HEADING_DEPTH)) - F.col("_i"))
    df = df.withColumn("_slack", F.min(slack).over(upto))
    depth = F.when(headed, F.least(F.col("_i") + F.least(F.lit(0), "_slack"), F.lit(MAX_HEADING_DEPTH)))
    df = df.withColumn("_depth", depth)
    levels = range(1, MAX_HEADING_DEPTH + 1)
    df = df.withColumns({f"_h{d}": F.last(F.when(F.col("_depth") == d, F.col("_here")), ignorenulls=True).over(upto) for d in levels})
    return df.withColumn("heading_path", _path(lambda d: F.col(f"_h{d}")))


def _long_paths(df: DataFrame, rows_per_segment: int) -> DataFrame:
    """Paths of documents of any length, by running values over segments."""
    key, order, seg = ["file_id"], ["seq"], block_of(F.col("seq"), rows_per_segment)

    # Depths and paths come from the heading rows alone, a small part of a document.
    heads = df.filter(F.col("level").isNotNull())
    heads = running(segmented(heads, key, seg), key, order, None, Running("sum", F.lit(1), "_i"))
    slack = F.least("level", F.lit(MAX_HEADING_DEPTH)) - F.col("_i")
    heads = running(heads, key, order, None, Running("min", slack, "_slack"))
    heads = heads.withColumn("_depth", F.least(F.col("_i") + F.least(F.lit(0), "_slack"), F.lit(MAX_HEADING_DEPTH)))
    here = F.struct("seq", F.trim("text").alias("text"))
    levels = range(1, MAX_HEADING_DEPTH + 1)
    heads = running(
        heads, key, order, None, *[Running("last", F.when(F.col("_depth") == d, here), f"_h{d}") for d in levels]
    )
    heads = heads.select(*df.columns, _path(lambda d: F.col(f"_h{d}")).alias("_path"))

    rest = df.filter(F.col("level").isNull()).withColumn("_path", F.lit(None).cast("array<string>"))
    out = running(
        rest.unionByName(heads), key, order, seg,
        Running("sum", F.when(F.col("kind") == "para", 1).otherwise(0), "para_no"),
        Running("last", F.col("_path"), "heading_path"),
    )
    return out.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>"))).drop("_path")


def block_locator(path: Column, para_no: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("§"), F.try_element_at(path, F.lit(-1))), F.concat(F.lit("¶"), para_no.cast("string"))
    )


def caption(first_row: Column) -> Column:
    """``a / b / c`` when a table's first row reads like a caption, else NULL."""
    cells = F.transform(F.split(first_row, r"\|"), lambda c: F.trim(c))
    filled = F.filter(F.slice(cells, 1, 3), lambda c: c != "")
    name = F.substring(F.array_join(filled, " / "), 1, CAPTION_CHARS)
    captioned = (F.size(cells) >= 2) & F.forall(cells, lambda c: F.length(c) <= CAPTION_CELL_CHARS) & (name != "")
    return F.when(captioned, name)


def _captioned_label(index: Column, name: Column) -> Column:
    plain = F.concat(F.lit("Table "), index.cast("string"))
    return F.when(name.isNotNull(), F.concat(plain, F.lit(' "'), name, F.lit('"'))).otherwise(plain)


def table_label(index: Column, first_row: Column) -> Column:
    """``Table n "a / b / c"`` when the first row reads like a caption, else ``Table n``."""
    return _captioned_label(index, caption(first_row))


def document_blocks(blocks: DataFrame, rows_per_segment: int = 100_000) -> DataFrame:
    """Locators for paragraphs and table rows; blank paragraphs count but are not kept.

    Table blocks carry table_index and row_no. Captions and blanks are told before the rows are
    shuffled, so that a caller without use for ``text`` shuffles none.
    """
    is_table = F.col("kind") == "table"
    told = blocks.withColumn("_kept", F.trim(F.coalesce("text", F.lit(""))) != "")
    if one_segment(blocks, "seq", rows_per_segment):
        told = told.withColumn("level", _block_level()).withColumn("_caption", F.when(is_table & F.col("file_id").isNotNull(), caption(F.col("text"))))
        df = _short_paths(told)
        # The rows lie together by document; its tables need only be sorted.
        table = Window.partitionBy("file_id", "table_index")
        df = df.withColumn("_first", F.min_by("_caption", F.when(is_table, F.col("row_no"))).over(table))
    else:
        df = _long_paths(told.withColumn("level", _block_level()), rows_per_segment)
        heads = blocks.filter(is_table).groupBy("file_id", "table_index").agg(F.min_by("text", "row_no").alias("_row"))
        df = df.join(heads.select("file_id", "table_index", caption(F.col("_row")).alias("_first")), ["file_id", "table_index"], "left")
    locator = F.when(is_table, _captioned_label(F.col("table_index"), F.col("_first"))).otherwise(
        block_locator(F.col("heading_path"), F.col("para_no"))
    )
    names = [*blocks.columns, "level", "para_no", "heading_path"]
    joined = ["file_id", "table_index"]  # first, as a join by them leaves them
    return (
        df.filter("_kept")
        .withColumn("locator", locator)
        .withColumn("text", F.trim("text"))
        .select(*joined, *[c for c in names if c not in joined], "locator")
    )


def section_runs(blocks: DataFrame, rows_per_segment: int = 100_000) -> DataFrame:
    """Number consecutive blocks that share kind and locator."""
    return islands(
        blocks, ["file_id"], ["seq"], block_of(F.col("seq"), rows_per_segment), ["kind", "locator"], "run_no"
    )


def part_locator(locator: Column, window_no: Column, windows: Column) -> Column:
    part = F.concat(
        F.lit(" (part "), (window_no + 1).cast("string"), F.lit(" of "), windows.cast("string"), F.lit(")")
    )
    return F.concat(locator, F.when(windows > 1, part).otherwise(F.lit("")))


def section_chunks(runs: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Windows over the joined text of each run; several windows get a part marker.

    runs: keys..., locator, <order>, text, where the keys name one run.

    A run of any length is never held in one row: every line gives each window it meets the slice of
    its tokens inside that window, and a window collects the slices of at most 700 tokens.
    """
    step = WINDOW_TOKENS - WINDOW_OVERLAP
    lines = runs.select(*keys, "locator", order, "text", token_count(F.col("text")).alias("_n"))
    offset = Running("sum", F.col("_n"), "_upto")
    placed = running(lines, keys, [order], block_of(F.col(order)), offset)
    total = lines.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    count = (F.floor(F.greatest(F.col("_total") - WINDOW_OVERLAP - 1, F.lit(0)) / step) + 1).cast("int")
    begin, end = F.col("_upto") - F.col("_n"), F.col("_upto")
    first = F.greatest(F.floor((begin - WINDOW_TOKENS) / step) + 1, F.lit(0))
    last = F.least(F.floor((end - 1) / step), F.col("windows") - 1)

    def piece(words: Column, w: Column) -> Column:
        low, high = F.greatest(begin, w * step), F.least(end, w * step + WINDOW_TOKENS)
        return F.struct(w.cast("int").alias("window_no"), F.slice(words, (low - begin + 1).cast("int"), (high - low).cast("int")).alias("_t"))

    pieces = let(tokens(F.col("text")), lambda words: F.transform(F.sequence(first, last), lambda w: piece(words, w)))
    met = placed.filter(F.col("_n") > 0).join(total.select(*keys, count.alias("windows")), keys)
    return (
        inline_rows(met, [*keys, "locator", "windows", order], pieces, "window_no")
        .groupBy(*keys, "locator", "windows", "window_no")
        .agg(F.array_sort(F.collect_list(F.struct(order, "_t"))).alias("_w"))
        .select(
            *keys,
            part_locator(F.col("locator"), F.col("window_no"), F.col("windows")).alias("locator"),
            "window_no",
            "windows",
            F.array_join(F.flatten(F.transform("_w", lambda s: s["_t"])), " ").alias("text"),
        )
    )


# --- packed rows -----------------------------------------------------------------------------
def row_span(first: Column, last: Column) -> Column:
    return F.when(last <= first, F.concat(F.lit("row "), first.cast("string"))).otherwise(
        F.concat(F.lit("rows "), first.cast("string"), F.lit("-"), last.cast("string"))
    )


def table_chunks(rows: DataFrame, budget: int = WINDOW_TOKENS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Whole table rows up to the budget; later chunks repeat the first row as header.

    rows: file_id, table_index, locator, row_no, text. Tables of one segment are packed with their
    texts in one shuffle; where any is longer, all go by ``next_fit``.
    """
    keys = ["file_id", "table_index"]
    rows = rows.dropna(subset=keys)
    if one_segment(rows, "row_no", segment_rows):
        upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        held = rows.filter(F.col("row_no").isNotNull()).select(*keys, "row_no", F.col("row_no").cast("long").alias("pos"), "locator", "text", token_count(F.col("text")).alias("_size"))
        sized = held.withColumn("_head", F.first("text").over(upto)).withColumn("_cost", F.first("_size").over(upto))
        body = pack_short(sized, keys, "pos", "_size", budget, ["row_no", "locator", "text", "_head"], reset=F.col("_cost"))
    else:
        heads = rows.groupBy(*keys).agg(F.min_by("text", "row_no").alias("_head"), F.min("row_no").alias("_row0"))
        sized = (
            rows.join(heads, keys)
            .withColumn("_size", token_count(F.col("text")))
            .withColumn("_pos", F.col("row_no") - F.col("_row0"))
        )
        packed = next_fit(sized, keys, "_pos", "_size", budget, reset=token_count(F.col("_head")), segment_rows=segment_rows)
        body = (
            sized.join(packed, (F.col("_pos") == F.col("pos")) & (sized.file_id == packed.file_id)
                       & (sized.table_index == packed.table_index))
            .select(sized.file_id, sized.table_index, "locator", "row_no", "text", "_head", "batch_no")
        )
    chunk = body.groupBy(*keys, "locator", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", F.col("text").alias("value")))).alias("_rows"),
        F.min("row_no").alias("first_row"),
        F.max("row_no").alias("last_row"),
        F.first("_head").alias("_head"),
    )
    lines = F.array_join(F.transform("_rows", lambda s: s["value"]), "\n")
    return chunk.select(
        *keys,
        "batch_no",
        F.concat(F.col("locator"), F.lit(", "), row_span(F.col("first_row"), F.col("last_row"))).alias("locator"),
        F.when(F.col("batch_no") > 0, F.concat(F.col("_head"), F.lit("\n"), lines)).otherwise(lines).alias("text"),
    )


# --- sheets ----------------------------------------------------------------------------------
def used_columns(cells: DataFrame) -> DataFrame:
    """Columns of a sheet that hold anything at all."""
    return (
        cells.groupBy("file_id", "sheet", "col_no")
        .agg(F.max(F.coalesce("value", F.lit("")) != "").alias("_any"))
        .filter("_any")
        .drop("_any")
    )


def _is_numeric_text(v: Column) -> Column:
    return F.regexp_replace(v, r"[.,-]", "").rlike(r"^[0-9]+$")


def header_rows(cells: DataFrame) -> DataFrame:
    """The best-scoring of the first rows of a sheet, the earliest on a tie; none if all score 0."""
    v = F.coalesce("value", F.lit(""))
    score = (
        cells.filter((F.col("row_no") <= HEADER_SCAN_ROWS) & (v != ""))
        .groupBy("file_id", "sheet", "row_no")
        .agg(
            F.count("*").alias("_filled"),
            F.count_if(F.length(v) <= HEADER_LABEL_CHARS).alias("_short"),
            F.count_if(~_is_numeric_text(v)).alias("_words"),
        )
        .filter(F.col("_filled") >= HEADER_MIN_CELLS)
        .withColumn("score", F.col("_filled") * 2 + F.col("_short") + F.col("_words"))
    )
    best = score.groupBy("file_id", "sheet").agg(F.max(F.struct("score", (-F.col("row_no")).alias("_r"))).alias("_b"))
    return best.select("file_id", "sheet", (-F.col("_b._r")).alias("header_row"), F.col("_b.score").alias("score"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Non-empty rows after the header over the used columns, joined with `` | ``.

    Columns: file_id, sheet, header_row, header_cells, row_no, text.
    """
    columns = used_columns(cells)
    used = cells.join(columns, ["file_id", "sheet", "col_no"], "left_semi")
    heads = header_rows(used)
    layout = columns.groupBy("file_id", "sheet").agg(F.array_sort(F.collect_list("col_no")).alias("_cols"))
    v = F.coalesce("value", F.lit(""))
    by_row = used.groupBy("file_id", "sheet", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", v.alias("value")))).alias("_m")
    )
    aligned = F.transform("_cols", lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit("")))
    rows = by_row.join(layout, ["file_id", "sheet"]).select("file_id", "sheet", "row_no", aligned.alias("_cells"))
    rows = rows.join(heads.drop("score"), ["file_id", "sheet"], "left")
    header = (
        rows.filter(F.col("row_no") == F.col("header_row"))
        .select("file_id", "sheet", F.col("_cells").alias("header_cells"))
    )
    return (
        rows.filter(F.col("header_row").isNull() | (F.col("row_no") > F.col("header_row")))
        .filter(F.exists("_cells", lambda c: c != ""))
        .join(header, ["file_id", "sheet"], "left")
        .select(
            "file_id", "sheet", "header_row",
            F.coalesce("header_cells", F.array().cast("array<string>")).alias("header_cells"),
            "row_no", F.trim(F.array_join("_cells", " | ")).alias("text"),
        )
    )


def sheet_locator(sheet: Column, first: Column, last: Column, header: Column) -> Column:
    named = F.filter(header, lambda c: c != "")
    more = F.when(F.size(named) > LOCATOR_COLUMNS, F.lit(" ...")).otherwise(F.lit(""))
    columns = F.concat(F.lit(" (cols: "), F.array_join(F.slice(named, 1, LOCATOR_COLUMNS), " | "), more, F.lit(")"))
    return F.concat(
        F.lit("sheet '"), sheet, F.lit("', "), row_span(first, last),
        F.when(F.size(named) > 0, columns).otherwise(F.lit("")),
    )


def sheet_chunks(rows: DataFrame, budget: int = WINDOW_TOKENS) -> DataFrame:
    """Rows packed per sheet up to the budget, the header line repeated on every chunk."""
    keys = ["file_id", "sheet"]
    header_line = F.regexp_replace(F.array_join("header_cells", " | "), r"^[ |]+|[ |]+$", "")
    sized = running(
        rows.withColumn("_head", header_line).withColumn("_size", token_count(F.col("text"))),
        keys, ["row_no"], block_of(F.col("row_no")), Running("sum", F.lit(1), "_pos"),
    ).withColumn("_pos", F.col("_pos") - 1)
    cost = token_count(F.col("_head"))
    packed = next_fit(sized, keys, "_pos", "_size", budget, initial=cost, reset=cost)
    body = sized.join(packed.withColumnRenamed("pos", "_pos"), [*keys, "_pos"])
    chunk = body.groupBy(*keys, "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", F.col("text").alias("value")))).alias("_rows"),
        F.min("row_no").alias("first_row"),
        F.max("row_no").alias("last_row"),
        F.first("_head").alias("_head"),
        F.first("header_cells").alias("header_cells"),
    )
    lines = F.array_join(F.transform("_rows", lambda s: s["value"]), "\n")
    return chunk.select(
        *keys, "batch_no", "first_row", "last_row",
        sheet_locator(F.col("sheet"), F.col("first_row"), F.col("last_row"), F.col("header_cells")).alias("locator"),
        F.when(F.col("_head") != "", F.concat(F.col("_head"), F.lit("\n"), lines)).otherwise(lines).alias("text"),
    )


# --- statistics ------------------------------------------------------------------------------
def block_stats(blocks: DataFrame) -> DataFrame:
    """Per document: blocks, paragraphs, table rows, tables, heading sections, characters."""
    table = F.col("kind") == "table"
    section = F.when(F.size("heading_path") > 0, F.array_join("heading_path", "\x1f"))
    return blocks.groupBy("file_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(~table).alias("paragraph_blocks"),
        F.count_if(table).alias("table_blocks"),
        F.count_distinct(F.when(table, F.col("table_index"))).alias("tables"),
        F.count_distinct(section).alias("headings"),
        F.sum(F.length("text")).alias("chars"),
    )


def sheet_stats(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """sheets: file_id, sheet, has_formulas. A workbook of formulas without one value is flagged."""
    counts = rows.groupBy("file_id", "sheet").agg(F.count("*").alias("_n"))
    return (
        sheets.join(counts, ["file_id", "sheet"], "left")
        .groupBy("file_id")
        .agg(
            F.count("*").alias("sheets"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
            F.bool_or("has_formulas").alias("has_formulas"),
            F.bool_and(F.col("has_formulas") & F.col("_n").isNull()).alias("formulas_without_values"),
        )
    )


