"""Headings, tables and sheets on small fixtures, and the heading rule against a plain stack."""

import random

from pyspark.sql import functions as F

from casefile_spark.operators import chunking as C

SCHEMA = "file_id int, seq int, kind string, style string, text string, table_index int, row_no int"


def blocks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_heading_levels(spark):
    styles = ["Title", "Heading 1", "heading 12", " Heading 3 ", "Heading", "Heading x", "Normal", None]
    df = spark.createDataFrame([(s,) for s in styles], "s string")
    assert [r[0] for r in df.select(C.heading_level(F.col("s"))).collect()] == [1, 1, 12, 3, None, None, None, None]


def test_heading_paths_against_a_stack(spark):
    rng, rows, want = random.Random(11), [], {}
    for doc in range(12):
        path = []
        for i in range(rng.choice([1, 7, 40])):
            level = rng.choice([None, None, 1, 2, 3, 4, 6])
            if level:
                path = path[: min(level - 1, len(path), 2)] + [f"h{i}"]
            want[doc, i] = list(path)
            rows.append((doc, i, "para", f"Heading {level}" if level else None, f"h{i}" if level else "body", None, None))
    for rows_per_segment in (3, 1000):
        got = C.heading_paths(blocks(spark, rows), rows_per_segment)
        assert {(r.file_id, r.seq): r.heading_path for r in got.collect()} == want


def test_block_locators(spark):
    rows = [
        (1, 0, "para", None, "intro", None, None), (1, 1, "para", None, "  ", None, None), (1, 2, "para", None, "second", None, None),
        (1, 3, "para", "Heading 1", "One", None, None), (1, 4, "para", "Heading 3", "Deep", None, None), (1, 5, "para", None, "text", None, None),
        (1, 6, "table", None, "Party | Role | Fee", 1, 1), (1, 7, "table", None, "A | B | 3", 1, 2), (1, 8, "table", None, "x" * 50 + " | y", 2, 1),
        (1, 9, "para", "Heading 2", "Two", None, None),
    ]
    got = {r.seq: r.locator for r in C.document_blocks(blocks(spark, rows)).collect()}
    assert got == {
        0: "¶1", 2: "¶3", 3: "§One", 4: "§Deep", 5: "§Deep", 6: 'Table 1 "Party / Role / Fee"', 7: 'Table 1 "Party / Role / Fee"', 8: "Table 2", 9: "§Two",
    }
    stats = C.block_stats(C.document_blocks(blocks(spark, rows))).first()
    assert (stats.blocks, stats.table_blocks, stats.tables, stats.headings) == (9, 3, 2, 3)


def test_sections_do_not_cross_and_carry_parts(spark):
    rows = [(1, 0, "para", "§A", "a"), (1, 1, "para", "§A", "b"), (1, 2, "para", "§B", " ".join(f"w{i}" for i in range(1500))), (1, 3, "para", "§A", "c")]
    runs = C.section_runs(spark.createDataFrame(rows, "file_id int, seq int, kind string, locator string, text string"))
    got = [(r.locator, len(r.text.split())) for r in C.section_chunks(runs, ["file_id", "run_no"]).orderBy("run_no", "window_no").collect()]
    assert got == [("§A", 2), ("§B (part 1 of 3)", 700), ("§B (part 2 of 3)", 700), ("§B (part 3 of 3)", 300), ("§A", 1)]


def test_table_rows_stay_whole_and_repeat_the_header(spark):
    rows = [(1, 1, "Table 1", i, "head | er" if i == 1 else f"r{i} " + "x " * 48) for i in range(1, 6)]
    got = C.table_chunks(spark.createDataFrame(rows, "file_id int, table_index int, locator string, row_no int, text string"), budget=110)
    out = got.orderBy("batch_no").collect()
    assert [r.locator for r in out] == ["Table 1, rows 1-3", "Table 1, rows 4-5"]
    assert out[1].text.splitlines()[0] == "head | er" and out[1].text.splitlines()[1].startswith("r4")


def sheet_cells(spark):
    rows = []
    for fid, first in ((1, 1), (2, 3)):
        if first == 3:
            rows += [(fid, "S", 1, 1, "Report"), (fid, "S", 2, 1, "March")]
        for c, name in enumerate(["Date", "Name", "Amount", "", "Note"], 1):
            rows.append((fid, "S", first, c, name))
        for r in range(first + 1, first + 6):
            values = [f"2025-01-{r:02d}", f"Person {r}", str(r * 100), "", "" if r % 2 else "seen"]
            rows += [(fid, "S", r, c, v) for c, v in enumerate(values, 1)]
        rows += [(fid, "T", 1, 1, "only"), (fid, "T", 2, 1, "prose")]
    return spark.createDataFrame(rows, "file_id int, sheet string, row_no int, col_no int, value string")


def test_sheet_header_columns_and_rows(spark):
    cells = sheet_cells(spark)
    assert {(r.file_id, r.sheet): r.header_row for r in C.header_rows(cells).collect()} == {(1, "S"): 1, (2, "S"): 3}
    assert {r.col_no for r in C.used_columns(cells).filter("sheet = 'S'").collect()} == {1, 2, 3, 5}
    rows = C.sheet_rows(cells)
    first = rows.filter("file_id = 2 AND sheet = 'S'").orderBy("row_no").first()
    assert (first.row_no, first.text, first.header_cells) == (4, "2025-01-04 | Person 4 | 400 | seen", ["Date", "Name", "Amount", "Note"])
    assert {r.row_no for r in rows.filter("sheet = 'T' AND file_id = 1").collect()} == {1, 2}


def test_sheet_chunks_repeat_header_and_stay_in_sheet(spark):
    got = C.sheet_chunks(C.sheet_rows(sheet_cells(spark)), budget=25).filter("file_id = 1").orderBy("sheet", "batch_no").collect()
    assert [r.locator for r in got] == [
        "sheet 'S', rows 2-3 (cols: Date | Name | Amount | Note)", "sheet 'S', rows 4-5 (cols: Date | Name | Amount | Note)",
        "sheet 'S', row 6 (cols: Date | Name | Amount | Note)", "sheet 'T', rows 1-2",
    ]
    assert all(r.text.startswith("Date | Name | Amount | Note\n") for r in got[:3]) and got[3].text == "only\nprose"


def test_locator_names_five_columns_at_most(spark):
    df = spark.createDataFrame([([*"abcdef"],)], "h array<string>")
    assert df.select(C.sheet_locator(F.lit("S"), F.lit(4), F.lit(4), F.col("h"))).first()[0] == "sheet 'S', row 4 (cols: a | b | c | d | e ...)"


def test_chunk_ids_are_reproducible(spark):
    df = spark.createDataFrame([("ab", 0, "x" * 300), ("ab", 0, "x" * 200 + "y"), ("ab", 1, "x" * 300)], "sha string, i int, t string")
    ids = [r[0] for r in df.select(C.chunk_id(F.col("sha"), F.col("i"), F.col("t"))).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_formula_only_workbook_is_flagged(spark):
    sheets = spark.createDataFrame([(1, "S", True), (1, "T", True), (2, "S", True)], "file_id int, sheet string, has_formulas boolean")
    rows = spark.createDataFrame([(2, "S")], "file_id int, sheet string")
    assert {r.file_id: (r.rows, r.formulas_without_values) for r in C.sheet_stats(sheets, rows).collect()} == {1: (0, True), 2: (1, False)}


def test_short_tables_are_packed_together_and_long_ones_by_segments(spark):
    """Both ways give the same chunks, repeated rows and nulls included; short tables take no Python call per table."""
    rng, rows = random.Random(9), []
    for table in range(300):
        first = rng.choice([1, 4])
        rows += [(table % 100, table // 100, f"T{table}", first + i, rng.choice([None, "", "a b", "w " * rng.randint(1, 30)])) for i in range(rng.choice([1, 2, 9, 40]))]
    rows += rows[:25] + [(None, 1, "T", 1, "a"), (1, None, "T", 1, "a"), (1, 1, "T", None, "a")]
    df = spark.createDataFrame(rows, "file_id int, table_index int, locator string, row_no int, text string")
    short, long = (C.table_chunks(df, budget=30, segment_rows=n) for n in (100_000, 7))
    columns = ["file_id", "table_index", "batch_no", "locator", "text"]
    assert sorted(map(str, short.select(*columns).collect())) == sorted(map(str, long.select(*columns).collect()))
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan and "Join" not in plan


def test_short_documents_take_one_shuffle_and_no_text(spark):
    """Both ways give the same blocks, rows that come twice and nulls included; locators alone shuffle no text."""
    rng, rows = random.Random(4), []
    for doc in [*range(30), None]:
        for i in range(rng.choice([1, 8, 30])):
            kind = rng.choice(["para", "para", "table"])
            text = rng.choice([None, " ", f" word{i} ", f"a{i} | b | c", f"long {'x' * 45} | y"])
            style = rng.choice([None, "Heading 1", "Heading 2", "Heading 5", "Title"]) if kind == "para" else None
            rows.append((doc, i, kind, style, text, rng.choice([1, 2, None]) if kind == "table" else None, i if kind == "table" else None))
    rows += rows[:9]
    df = blocks(spark, rows)
    short, long = (C.document_blocks(df, n) for n in (1000, 5))
    assert short.columns == long.columns
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))
    located = short.select("file_id", "seq", "kind", "locator")._jdf.queryExecution()
    assert located.executedPlan().toString().count("Exchange") == 1 and "Join" not in located.optimizedPlan().toString()
