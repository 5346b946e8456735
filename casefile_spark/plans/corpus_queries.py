"""Registered source, chunking and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import html_to_text, legible_ratio, token_count
from ..operators import chunking as C
from ..operators import quality as Q
from ..sources import catalogues, files, messages, pages, sinks
from . import bindings as B
from .ledger_queries import _FILE_MATTERS, _FILES, _at, _stored_index, doc_matters

_TOKENS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


def _windows(source: str, keys: str, text: str = "text") -> str:
    """SQL for overlapping windows of a relation: keys, n windows, k, window text."""
    return f"""
tok AS (SELECT {keys}, {_TOKENS.format(text)} AS t FROM {source}),
win AS (SELECT {keys}, greatest(len(t) - 101, 0) // 600 + 1 AS windows, t,
  unnest(range(0, greatest(len(t) - 101, 0) // 600 + 1)) AS k FROM tok WHERE len(t) > 0),
chunk AS (SELECT {keys}, windows, k AS window_no, array_to_string(t[k * 600 + 1 : k * 600 + 700], ' ') AS text FROM win)"""


_HTML = """
bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '</?[A-Za-z!?][^>]*>', '', 'g') AS t FROM pages),
ents AS (SELECT page_id, replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS t FROM bare),
plain AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM ents)"""


# --- sources ---------------------------------------------------------------------------------
def a1_content_hash(spark, sf):
    d = B.table(spark, sf, "documents")
    sha = files.content_hash(F.col("text"))
    return d.select(
        "doc_id", sha.alias("content_sha256"), files.collection_name(B.matter_of(F.col("source")), sha).alias("collection"),
        files.collection_name(F.lit(None).cast("long"), sha).alias("loose_collection"),
    )


def _page_text(spark, sf):
    """Pages as a native layer; every page whose document was flagged low quality lost its native text."""
    p = B.table(spark, sf, "pages").join(
        B.table(spark, sf, "labels").withColumnRenamed("doc_id", "page_id"), "page_id", "left"
    )
    p = p.withColumn("t", html_to_text(F.col("html")))
    text = F.col("t")
    lost = F.coalesce(F.col("quality") == 0, F.lit(False))
    ocr = F.when(lost & (F.coalesce("toxic", F.lit(0)) == 0), text)
    return p.select(
        F.floor(F.col("page_id") / 10).alias("file_id"), (F.col("page_id") % 10 + 1).alias("page_no"),
        F.when(~lost, text).alias("native_text"), ocr.alias("ocr_text"), F.when(F.col("page_id") % 2 == 0, 0.995).otherwise(0.5).alias("near_white"),
    )


def a1_corpus_scan(spark, sf):
    """Pages as one file each: half of them are scanned, then the others arrive and the second scan reads only those."""
    from ..session import shared_folder

    folder, ledger, scanned = (shared_folder(spark, name) for name in ("pages", "seen", "scanned"))
    pages = B.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    parts = pages.count() // files.FOLDER_FILES + 1
    for scan, part in ((1, "page_id % 2 = 0"), (2, "page_id % 2 <> 0")):
        for k, at in enumerate(files.write_texts(pages.filter(part), folder, "page_id", "html", parts)):
            # A folder at a time, and each scan before the next pages arrive: it finds and reads its own alone.
            seen = spark.read.schema(files.LISTED).parquet(f"{ledger}/{k}/*") if scan > 1 else spark.createDataFrame([], files.LISTED)
            listed = files.list_corpus(spark, at).filter("file_type = 'txt'")
            files.new_files(listed, seen).write.parquet(f"{ledger}/{k}/{scan}")
            fresh = spark.read.schema(files.LISTED).parquet(f"{ledger}/{k}/{scan}")
            good, _ = files.scan_files(spark, at, fresh, suffixes=(".txt",))
            good.withColumn("scan", F.lit(scan)).write.mode("append").parquet(scanned)
    page = F.regexp_extract("stored_path", r"page_id=(\d+)", 1).cast("long")
    return spark.read.parquet(scanned).select(page.alias("page_id"), "scan", "length", "content_sha256", "collection")


def a2_page_triage(spark, sf):
    t = pages.triage_pages(_page_text(spark, sf))
    return t.select("file_id", "page_no", "status", F.coalesce(F.md5("text"), F.lit("")).alias("digest"))


def _parts(spark, sf):
    """Turns as message parts: users write plain text, assistants HTML, system turns are attachments."""
    c = B.table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("msg_id"), F.col("turn").alias("part_no"),
        F.when(F.col("role") == "user", "text/plain").when(F.col("role") == "assistant", "text/html").otherwise("application/pdf").alias("content_type"),
        F.when(F.col("role") == "system", "attachment").alias("disposition"),
        F.when(F.col("turn") > 0, F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(F.col("text")).alias("content"),
    )


def a3_message_bodies(spark, sf):
    parts = _parts(spark, sf)
    names = messages.attachment_names(parts)
    bodies = messages.message_bodies(parts)
    return bodies.join(names, "msg_id", "left").select(
        "msg_id", F.md5("body").alias("digest"), F.coalesce(F.array_join("attachments", ","), F.lit("")).alias("attachments")
    )


def a4_message_headers(spark, sf):
    """Customers as senders, with order dates as header dates."""
    o = B.table(spark, sf, "orders").join(B.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    sender = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("<"), address, F.lit(">")))
        .when(F.col("c_mktsegment") == "FURNITURE", address)
        .otherwise(F.concat(F.lit('"'), "c_name", F.lit('" <'), address, F.lit(">")))
    )
    date = F.when(F.col("o_orderstatus") == "P", "no date").otherwise(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss '-0500'"))
    msgs = o.select(F.col("o_orderkey").alias("msg_id"), F.create_map(F.lit("from"), sender, F.lit("date"), date).alias("headers"))
    return messages.message_headers(msgs).select("msg_id", "sender_name", "sender_email", "date_iso", "locator")


def a5_html_to_text(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def a9_chunk_index(spark, sf):
    """Write all chunks, replace the files of one language by shorter ones, count what is stored."""
    from ..session import shared_folder

    folder = shared_folder(spark, "index")
    chunks = _file_chunks(spark, sf)
    sinks.replace_files(folder, chunks, buckets=4)
    german = chunks.filter((F.col("lang") == "de") & (F.col("chunk_index") == 0))
    none_left = chunks.filter(F.col("lang") == "es").select("matter_id", "file_id").distinct()
    sinks.replace_files(folder, german, gone=none_left, buckets=4)
    stored = sinks.read_chunks(spark, folder)
    return stored.groupBy("matter_id", "lang").agg(
        F.count("*").alias("chunks"), F.count_distinct("file_id").alias("files"), F.sum(F.length("text")).alias("chars")
    )


def _file_chunks(spark, sf):
    return C.window_chunks(B.texts(spark, sf), "text", ["matter_id", "file_id", "lang"]).withColumnRenamed("window_no", "chunk_index")


def k4_purge_index(spark, sf):
    """Chunks per matter before and after a purge of expired matters, read from the index and its earlier version."""
    from ..operators import registry as K
    from ..session import shared_folder
    from ..sources.chunk_index import ChunkIndex

    index = ChunkIndex(spark, shared_folder(spark, "purge"), buckets=4)
    first = index.write(_file_chunks(spark, sf))
    removed = K.purge(B.files(spark, sf), doc_matters(spark, sf), _at(B.AS_OF), limit=K.PURGE_BATCH)["removed_files"]
    index.write(gone=removed)
    counts = [index.read(v).groupBy("matter_id").agg(F.count("*").alias(name)) for v, name in ((first, "before"), (None, "after"))]
    return counts[0].join(counts[1], "matter_id", "left").select("matter_id", "before", F.coalesce("after", F.lit(0)).alias("after"))


def a11_catalogue(spark, sf):
    """Suppliers as catalogue entries in nested JSON: region, nation, supplier, required documents."""
    s = (
        B.table(spark, sf, "supplier")
        .join(B.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(B.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    docs = F.array(*[
        F.struct(F.concat(F.lit(f"doc {i} of "), "s_name").alias("name"), F.lit(f"Form {i}A").alias("form_number"), F.lit("").alias("notes"))
        for i in (1, 2)
    ])
    entry = F.struct(
        F.col("s_name").alias("description"), F.concat(F.lit("Rule "), F.col("s_suppkey").cast("string")).alias("rule_citation"),
        F.when(F.col("s_acctbal") > 0, docs).otherwise(F.slice(docs, 1, 0)).alias("required_documents"),
    )
    nested = F.create_map(F.col("r_name"), F.create_map(F.col("n_name"), F.create_map(F.col("s_name"), entry)))
    flat = catalogues.flatten_catalogue(s.select(F.to_json(nested).alias("value")))
    return flat.select("forum", "proceeding", "deadline", "rule_citation", "doc_no", "name", "form_number")


def a12_model_catalogue(spark, sf):
    return catalogues.normalise_models(B.raw_models(spark, sf)).select(
        "id", "provider", F.round("price_per_million", 4).alias("price_per_million"), "tier", "context_length"
    )


# --- chunking --------------------------------------------------------------------------------
def b1_token_windows(spark, sf):
    w = C.window_chunks(B.texts(spark, sf), "text", ["file_id"])
    return w.select("file_id", "window_no", "windows", token_count(F.col("text")).alias("tokens"), F.md5("text").alias("digest"))


def b2_page_chunks(spark, sf):
    ok = pages.readable_pages(pages.triage_pages(_page_text(spark, sf)))
    w = C.page_chunks(ok, ["file_id", "page_no", "is_ocr"])
    return w.select("file_id", "locator", "window_no", F.md5("text").alias("digest"))


def b3_message_chunks(spark, sf):
    w = C.message_chunks(B.messages(spark, sf), "text", ["conv_id", "turn", "locator"])
    return w.select("conv_id", "turn", "locator", "window_no", F.md5("text").alias("digest"))


def _blocks(spark, sf):
    """Lines as document blocks: very short lines are headings, lines with a colon table rows."""
    n = F.length("line")
    style = F.when(n < 30, F.concat(F.lit("Heading "), (n % 4 + 1).cast("string"))).when(n < 35, "Title")
    table = F.col("line").contains(":")
    return B.lines(spark, sf).select(
        "file_id", F.col("line_no").alias("seq"), F.when(table, "table").otherwise("para").alias("kind"),
        F.when(~table, style).alias("style"), F.col("line").alias("text"),
        F.when(table, F.lit(1)).alias("table_index"), F.when(table, F.col("line_no")).alias("row_no"),
    )


def b4_heading_levels(spark, sf):
    b = _blocks(spark, sf).withColumn("level", C.heading_level(F.col("style")))
    return b.groupBy("style", "level").agg(F.count("*").alias("blocks"))


def b5_heading_paths(spark, sf):
    p = C.heading_paths(_blocks(spark, sf), rows_per_segment=50)
    return p.select("file_id", "seq", F.array_join("heading_path", " > ").alias("path"))


def b6_block_locators(spark, sf):
    return C.document_blocks(_blocks(spark, sf)).select("file_id", "seq", "kind", "locator")


def b7_table_labels(spark, sf):
    p = B.table(spark, sf, "part")
    wide = F.concat_ws(" | ", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), "p_type", "p_brand", "p_name")
    row = F.when(F.col("p_size") > 45, F.col("p_name")).when(F.col("p_size") < 5, F.concat(F.repeat(F.lit("long "), 10), wide)).otherwise(wide)
    return p.select("p_partkey", C.table_label(F.col("p_size"), row).alias("label"))


def b8_event_runs(spark, sf):
    """Consecutive events of one type per user, cut where the events lie so that no user is one task."""
    from ..functions.segments import islands, ranged

    e = ranged(B.events(spark, sf).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    runs = islands(e.withColumnRenamed("_seg", "_range"), ["user_id"], ["ts", "event_id"], F.col("_range"), ["event_type"], "run_no")
    return runs.groupBy("user_id", "run_no", "event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def b9_section_chunks(spark, sf):
    """Each document's lines as one section; several windows carry a part marker."""
    runs = B.lines(spark, sf).join(B.texts(spark, sf).select("file_id", "lang"), "file_id").select(
        "file_id", F.concat(F.lit("§"), "lang").alias("locator"), F.col("line_no").alias("seq"), F.col("line").alias("text")
    )
    return C.section_chunks(runs, ["file_id"]).select("file_id", "window_no", "locator", F.md5("text").alias("digest"))


def b9_turn_sections(spark, sf):
    """Consecutive turns of one role in a conversation as one section."""
    t = B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("seq"), F.lit("para").alias("kind"), F.col("role").alias("locator"), "text"
    )
    return C.section_chunks(C.section_runs(t), ["file_id", "run_no"]).select("file_id", "run_no", "locator", F.md5("text").alias("digest"))


def b10_table_chunks(spark, sf):
    """Lines of every document as rows of one table, packed to 120 tokens."""
    rows = B.lines(spark, sf).select(
        "file_id", F.lit(1).alias("table_index"), F.lit("Table 1").alias("locator"), (F.col("line_no") + 1).alias("row_no"), F.col("line").alias("text")
    )
    return C.table_chunks(rows, budget=120).select("file_id", "batch_no", "locator", F.md5("text").alias("digest"))


def b11_used_columns(spark, sf):
    return C.used_columns(B.cells(spark, sf))


def b12_header_rows(spark, sf):
    return C.header_rows(B.cells(spark, sf))


def b13_sheet_rows(spark, sf):
    return C.sheet_rows(B.cells(spark, sf)).select("file_id", "sheet", "header_row", "row_no", "text")


def b14_sheet_chunks(spark, sf):
    """Sheet rows packed to 60 tokens, header line included on every chunk."""
    out = C.sheet_chunks(C.sheet_rows(B.cells(spark, sf)), budget=60)
    return out.select("file_id", "sheet", "batch_no", "locator", F.md5("text").alias("digest"))


def b15_chunk_ids(spark, sf):
    d = B.texts(spark, sf).withColumn("sha", F.sha2("text", 256))
    w = C.window_chunks(d, "text", ["file_id", "sha"])
    return w.select("file_id", "window_no", C.chunk_id(F.col("sha"), F.col("window_no"), F.col("text")).alias("chunk_id"))


def b16_block_stats(spark, sf):
    return C.block_stats(C.document_blocks(_blocks(spark, sf)))


def b16_sheet_stats(spark, sf):
    c = B.cells(spark, sf)
    sheets = c.groupBy("file_id", "sheet").agg((F.max(F.length("value")) > 12).alias("has_formulas"))
    return C.sheet_stats(sheets, C.sheet_rows(c))


# --- quality and state -----------------------------------------------------------------------
def c1_legible_ratio(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.round(legible_ratio(F.col("text")), 6).alias("ratio"))


def _quality_pages(spark, sf):
    flags = B.files(spark, sf).select("file_id", F.coalesce("scanned", F.lit(False)).alias("is_ocr"))
    return B.lines(spark, sf).select("file_id", F.col("line").alias("text")).join(flags, "file_id")


def c2_extraction_verdict(spark, sf):
    out = Q.extraction_verdict(B.files(spark, sf), _quality_pages(spark, sf))
    return out.select("file_id", "chars", F.round("chars_per_page", 6).alias("chars_per_page"), F.round("legible_ratio", 6).alias("legible_ratio"), "quality", "quality_detail")


def c3_ingest_outcome(spark, sf):
    f = B.files(spark, sf)
    verdict = Q.extraction_verdict(f, _quality_pages(spark, sf))
    out = Q.ingest_outcome(verdict, _file_chunks(spark, sf), f.filter(F.col("scanned").isNotNull()))
    return out.select("file_id", "chunk_count", "quality", "was_reindexed")


def c4_duplicate_uploads(spark, sf):
    return Q.duplicate_uploads(B.files(spark, sf), ["created_at", "file_id"]).select("matter_id", "file_id", "kept_file_id")


def c4_first_copies(spark, sf):
    """Copies over the whole corpus, whatever the matter."""
    f = B.files(spark, sf).withColumn("matter_id", F.lit(0))
    return Q.first_copies(f, ["created_at", "file_id"]).select("content_sha256", "kept_file_id", "copies")


def c5_upload_actions(spark, sf):
    """Everything uploaded again into the neighbouring numbering: live content is a duplicate, deleted content returns."""
    f = B.files(spark, sf)
    held = f.filter(F.col("scanned").isNotNull())
    staged = f.select("matter_id", (F.col("file_id") + 1_000_000).alias("upload_id"), "content_sha256")
    return Q.upload_actions(staged, held).select("matter_id", "upload_id", "action", "existing_file_id")


def c6_files_to_index(spark, sf):
    f = B.files(spark, sf)
    stored = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"))
    return Q.files_to_index(f, stored, force=F.coalesce("scanned", F.lit(False))).select("file_id", "indexed")


def c7_verify_written(spark, sf):
    stored = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"))
    return Q.verify_written(B.files(spark, sf), stored)


def c8_latest_status(spark, sf):
    e = B.events(spark, sf)
    status = F.get(F.array(*[F.lit(s) for s in Q.STATUS_LABELS]), (F.col("event_id") % 6).cast("int"))
    ev = e.select(F.col("user_id").alias("file_id"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("at"), "event_id")
    return Q.latest_status(ev).select("file_id", "ingest_status", "queryable", "label")


def c9_health(spark, sf):
    probed = Q.probe_indexes(B.files(spark, sf), *_stored_index(spark, sf), dim=64)
    return Q.reconcile_health(probed).select("file_id", "state", "ingest_status", "ingest_error")


def c9_health_summary(spark, sf):
    return Q.health_summary(Q.probe_indexes(B.files(spark, sf), *_stored_index(spark, sf), dim=64))


def c10_files_to_reprocess(spark, sf):
    f = B.files(spark, sf)
    return Q.files_to_reprocess(f, 3).select("file_id", "ingest_status")


QUERIES = {f.__name__: f for f in (
    a1_content_hash, a1_corpus_scan, a2_page_triage, a3_message_bodies, a4_message_headers, a5_html_to_text, a9_chunk_index, k4_purge_index, a11_catalogue,
    a12_model_catalogue, b1_token_windows, b2_page_chunks, b3_message_chunks, b4_heading_levels, b5_heading_paths,
    b6_block_locators, b7_table_labels, b8_event_runs, b9_section_chunks, b9_turn_sections, b10_table_chunks,
    b11_used_columns, b12_header_rows, b13_sheet_rows, b14_sheet_chunks, b15_chunk_ids, b16_block_stats, b16_sheet_stats,
    c1_legible_ratio, c2_extraction_verdict, c3_ingest_outcome, c4_duplicate_uploads, c4_first_copies, c5_upload_actions,
    c6_files_to_index, c7_verify_written, c8_latest_status, c9_health, c9_health_summary, c10_files_to_reprocess,
)}

_PAGE_TEXT = f"""{_HTML},
pt AS (SELECT page_id // 10 AS file_id, page_id % 10 + 1 AS page_no, text, coalesce(quality = 0, false) AS lost,
  coalesce(toxic, 0) = 0 AS scanned_ok, page_id % 2 = 0 AS white FROM plain LEFT JOIN labels ON doc_id = page_id),
triage AS (SELECT *, CASE WHEN NOT lost AND text <> '' THEN 'native' WHEN lost AND scanned_ok AND text <> '' THEN 'ocr'
  WHEN white THEN 'blank' ELSE 'unreadable' END AS status FROM pt)"""
_LINES = """
lines AS (SELECT doc_id AS file_id, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id, lang,
  unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
# Headings: the depth rule as windows over each document; slots hold while nothing shallower followed.
_BLOCKS = f"""{_LINES},
b AS (SELECT file_id, line_no AS seq, line, line LIKE '%:%' AS tab, CASE WHEN line LIKE '%:%' THEN NULL
  WHEN length(line) < 30 THEN length(line) % 4 + 1 WHEN length(line) < 35 THEN 1 END AS style_level FROM lines),
lv AS (SELECT *, CASE WHEN trim(line) <> '' THEN style_level END AS level FROM b),
i AS (SELECT *, count(level) OVER w AS i, count(*) FILTER (NOT tab) OVER w AS para_no FROM lv
  WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
s AS (SELECT *, CASE WHEN level IS NOT NULL THEN least(3, i + least(0, min(CASE WHEN level IS NOT NULL THEN least(level, 3) - i END)
  OVER (PARTITION BY file_id ORDER BY seq))) END AS depth FROM i),
h AS (SELECT *, max(CASE WHEN depth = 1 THEN seq END) OVER w AS s1, max(CASE WHEN depth = 2 THEN seq END) OVER w AS s2,
  max(CASE WHEN depth = 3 THEN seq END) OVER w AS s3 FROM s WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
p AS (SELECT h.file_id, h.seq, h.tab, h.line, h.para_no, concat_ws(' > ', trim(a.line),
  CASE WHEN s2 > coalesce(s1, -1) THEN trim(b2.line) END, CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN trim(c.line) END) AS path,
  coalesce(CASE WHEN s3 > greatest(coalesce(s1, -1), coalesce(s2, -1)) THEN trim(c.line) END, CASE WHEN s2 > coalesce(s1, -1) THEN trim(b2.line) END, trim(a.line)) AS deepest
  FROM h LEFT JOIN b a ON a.file_id = h.file_id AND a.seq = s1 LEFT JOIN b b2 ON b2.file_id = h.file_id AND b2.seq = s2
  LEFT JOIN b c ON c.file_id = h.file_id AND c.seq = s3),
heads AS (SELECT file_id, arg_min(line, seq) AS head FROM b WHERE tab GROUP BY file_id),
parts AS (SELECT file_id, list_transform(string_split(head, '|'), lambda x: trim(x)) AS c FROM heads),
names AS (SELECT file_id, CASE WHEN len(c) >= 2 AND len(list_filter(c, lambda x: length(x) > 40)) = 0
  THEN substr(array_to_string(list_filter(c[1:3], lambda x: x <> ''), ' / '), 1, 48) ELSE '' END AS name FROM parts),
loc AS (SELECT p.*, CASE WHEN tab THEN 'Table 1' || CASE WHEN name <> '' THEN ' "' || name || '"' ELSE '' END
  ELSE coalesce('§' || deepest, '¶' || para_no) END AS locator FROM p LEFT JOIN names USING (file_id) WHERE trim(line) <> '')"""
_CELLS = """
rowed AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_type ORDER BY p_partkey) AS row_no FROM part),
cells AS (SELECT p_size AS file_id, p_type AS sheet, row_no, unnest([1, 2, 3, 4, 5, 6, 7]) AS col_no,
  unnest([p_name, p_brand, p_type, p_size::VARCHAR, printf('%.2f', p_retailprice), '', CASE WHEN p_brand = 'Brand#7' THEN 'x' ELSE '' END]) AS value FROM rowed),
used AS (SELECT DISTINCT file_id, sheet, col_no FROM cells WHERE value <> ''),
score AS (SELECT file_id, sheet, row_no, count(*) * 2 + count(*) FILTER (length(value) <= 28)
  + count(*) FILTER (NOT regexp_full_match(regexp_replace(value, '[.,-]', '', 'g'), '[0-9]+')) AS score FROM cells
  WHERE value <> '' AND row_no <= 10 GROUP BY ALL HAVING count(*) >= 3),
heads AS (SELECT file_id, sheet, row_no AS header_row, score FROM score QUALIFY row_number() OVER (PARTITION BY file_id, sheet ORDER BY score DESC, row_no) = 1),
texts AS (SELECT file_id, sheet, row_no, string_agg(value, ' | ' ORDER BY col_no) AS raw, max(value <> '') AS filled,
  list(value ORDER BY col_no) AS vals FROM cells SEMI JOIN used USING (file_id, sheet, col_no) GROUP BY ALL),
rows_ AS (SELECT t.file_id, t.sheet, header_row, row_no, trim(raw) AS text FROM texts t LEFT JOIN heads h USING (file_id, sheet)
  WHERE filled AND (header_row IS NULL OR row_no > header_row))"""
_QUALITY = f"""{_FILES},{_LINES},
m AS (SELECT file_id, count(*) AS pages, sum(length(line)) AS chars,
  sum(length(regexp_replace(line, '[^\\x09-\\x0D\\x20-\\x7E]', '', 'g'))) AS legible FROM lines GROUP BY file_id),
v AS (SELECT f.file_id, coalesce(m.chars, 0) AS chars, CASE WHEN pages > 0 THEN m.chars / pages ELSE 0 END AS cpp,
  CASE WHEN m.chars > 0 THEN legible / m.chars ELSE 1 END AS ratio, coalesce(scanned, false) AS ocr, pages FROM files f LEFT JOIN m USING (file_id)),
verdict AS (SELECT *, CASE WHEN pages IS NULL THEN 'failed_no_text' WHEN ocr AND (cpp < 150 OR ratio < 0.85) THEN 'ocr_low_quality' ELSE 'ok' END AS quality FROM v)"""
_HEALTH = f"""{_FILES},
held AS (SELECT f.collection, count(*) AS n, count(*) FILTER (label = 3) AS bad FROM files f JOIN embeddings e ON e.vec_id = f.file_id GROUP BY 1),
known AS (SELECT collection FROM held UNION SELECT collection FROM files WHERE scanned IS NOT NULL),
probed AS (SELECT f.*, CASE WHEN f.collection NOT IN (SELECT collection FROM known) THEN 'missing'
  WHEN n IS NULL THEN 'empty' WHEN bad > 0 THEN 'unreadable' ELSE 'ok' END AS state FROM files f LEFT JOIN held USING (collection)
  WHERE ingest_status <> 'failed_no_text')"""

SQL = {
    "a1_content_hash": """
SELECT doc_id, sha256(text) AS content_sha256, 'm' || regexp_extract(source, '(\\d+)$', 1) || '-' || substr(sha256(text), 1, 16) AS collection,
  'day1-' || substr(sha256(text), 1, 16) AS loose_collection FROM documents""",
    "a1_corpus_scan": """
WITH f AS (SELECT page_id, coalesce(html, '') || chr(10) AS body FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS scan, octet_length(encode(body)) AS length, sha256(body) AS content_sha256, 'day1-' || substr(sha256(body), 1, 16) AS collection FROM f""",
    "a2_page_triage": f"""
WITH {_PAGE_TEXT} SELECT file_id, page_no, status, CASE WHEN status IN ('native', 'ocr') THEN md5(text) ELSE '' END AS digest FROM triage""",
    "a3_message_bodies": """
WITH u AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1),
a AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY 1),
s AS (SELECT conv_id, string_agg(CASE WHEN turn > 0 THEN 'f' || turn || '.pdf' ELSE '(unnamed attachment)' END, ',' ORDER BY turn) AS n
  FROM conversations WHERE role = 'system' GROUP BY 1),
i AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id AS msg_id, md5(coalesce(regexp_replace(coalesce(u.t, a.t), '^\\s+|\\s+$', '', 'g'), '')) AS digest, coalesce(n, '') AS attachments
FROM i LEFT JOIN u USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN s USING (conv_id)""",
    "a4_message_headers": """
WITH m AS (SELECT o_orderkey AS msg_id, CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'c' || c_custkey || '@example.com' ELSE c_name END AS sender_name,
  'c' || c_custkey || '@example.com' AS sender_email, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_iso
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT *, 'from ' || sender_name || CASE WHEN date_iso <> '' THEN ', ' || date_iso ELSE '' END AS locator FROM m""",
    "a5_html_to_text": f"WITH {_HTML} SELECT page_id, length(text) AS chars, md5(text) AS digest FROM plain",
    "a9_chunk_index": f"""
WITH src AS (SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id, doc_id AS file_id, lang, text FROM documents),
{_windows('src', 'matter_id, file_id, lang')}
SELECT matter_id, lang, count(*) AS chunks, count(DISTINCT file_id) AS files, sum(length(text)) AS chars FROM chunk
WHERE lang <> 'es' AND (lang <> 'de' OR window_no = 0) GROUP BY matter_id, lang""",
    "k4_purge_index": f"""
WITH {_FILES},{_FILE_MATTERS},
gf AS (SELECT file_id FROM files WHERE deleted_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY ORDER BY deleted_at, file_id LIMIT 25),
gm AS (SELECT matter_id FROM doc_matters WHERE deleted_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY ORDER BY deleted_at, matter_id LIMIT 25),
src AS (SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id, doc_id AS file_id, text FROM documents), {_windows('src', 'matter_id, file_id')}
SELECT matter_id, count(*) AS before, count(*) FILTER (file_id NOT IN (SELECT file_id FROM gf) AND matter_id NOT IN (SELECT matter_id FROM gm)) AS after
FROM chunk GROUP BY matter_id""",
    "a11_catalogue": """
WITH s AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS forum, n_name AS proceeding, s_name AS deadline, 'Rule ' || s_suppkey AS rule_citation, i - 1 AS doc_no,
  'doc ' || i || ' of ' || s_name AS name, 'Form ' || i || 'A' AS form_number FROM s, (VALUES (1), (2)) v(i) WHERE s_acctbal > 0
UNION ALL SELECT r_name, n_name, s_name, 'Rule ' || s_suppkey, NULL, NULL, NULL FROM s WHERE NOT s_acctbal > 0""",
    "a12_model_catalogue": """
SELECT lower(p_brand) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS id, lower(p_brand) AS provider,
  round((p_retailprice / 1e8 + 0) * 1000000 + (p_size / 1e7) * 1000000, 4) AS price_per_million,
  CASE WHEN (p_retailprice / 1e8) * 1000000 + (p_size / 1e7) * 1000000 <= 2.25 THEN '$'
    WHEN (p_retailprice / 1e8) * 1000000 + (p_size / 1e7) * 1000000 <= 17.5 THEN '$$' ELSE '$$$' END AS tier,
  p_size * 1000 AS context_length FROM part""",
    "b1_token_windows": f"""
WITH src AS (SELECT doc_id AS file_id, text FROM documents), {_windows('src', 'file_id')}
SELECT file_id, window_no, windows, len(string_split(text, ' ')) AS tokens, md5(text) AS digest FROM chunk""",
    "b2_page_chunks": f"""
WITH {_PAGE_TEXT}, ok AS (SELECT file_id, 'p.' || page_no || CASE WHEN status = 'ocr' THEN ' (OCR)' ELSE '' END AS locator, text FROM triage
  WHERE status IN ('native', 'ocr')), {_windows('ok', 'file_id, locator')}
SELECT file_id, locator, window_no, md5(text) AS digest FROM chunk""",
    "b3_message_chunks": f"""
WITH src AS (SELECT conv_id, turn, 'from ' || role || ', turn ' || turn AS locator, text FROM conversations),
{_windows('src', 'conv_id, turn, locator')}
SELECT conv_id, turn, locator, window_no, md5(text) AS digest FROM chunk""",
    "b4_heading_levels": f"""
WITH {_LINES}, s AS (SELECT CASE WHEN line LIKE '%:%' THEN NULL WHEN length(line) < 30 THEN 'Heading ' || (length(line) % 4 + 1)
  WHEN length(line) < 35 THEN 'Title' END AS style FROM lines)
SELECT style, CASE WHEN style = 'Title' THEN 1 ELSE try_cast(right(style, 1) AS INT) END AS level, count(*) AS blocks FROM s GROUP BY ALL""",
    "b5_heading_paths": f"WITH {_BLOCKS} SELECT file_id, seq, path FROM p",
    "b6_block_locators": f"WITH {_BLOCKS} SELECT file_id, seq, CASE WHEN tab THEN 'table' ELSE 'para' END AS kind, locator FROM loc",
    "b7_table_labels": """
WITH w AS (SELECT *, p_name || ' | ' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END || ' | ' || p_type || ' | ' || p_brand || ' | ' || p_name AS wide FROM part)
SELECT p_partkey, 'Table ' || p_size || CASE WHEN p_size > 45 OR p_size < 5 THEN ''
  ELSE ' "' || substr(concat_ws(' / ', p_name, CASE WHEN p_size > 25 THEN p_brand END, p_type), 1, 48) || '"' END AS label FROM w""",
    "b8_event_runs": """
WITH l AS (SELECT *, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM l)
SELECT user_id, run_no, event_type, count(*) AS events, min(event_id) AS first_event FROM r GROUP BY ALL""",
    "b9_section_chunks": f"""
WITH src AS (SELECT doc_id AS file_id, lang, text FROM documents), {_windows('src', 'file_id, lang')}
SELECT file_id, window_no, '§' || lang || CASE WHEN windows > 1 THEN ' (part ' || (window_no + 1) || ' of ' || windows || ')' ELSE '' END AS locator,
  md5(text) AS digest FROM chunk""",
    "b9_turn_sections": f"""
WITH l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
r AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run_no FROM l),
src AS (SELECT conv_id AS file_id, run_no, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY ALL),
{_windows('src', 'file_id, run_no, role')}
SELECT file_id, run_no, role || CASE WHEN windows > 1 THEN ' (part ' || (window_no + 1) || ' of ' || windows || ')' ELSE '' END AS locator, md5(text) AS digest FROM chunk""",
    "b10_table_chunks": f"""
WITH RECURSIVE {_LINES},
sized AS (SELECT file_id, line_no AS pos, line, len({_TOKENS.format("line")}) AS size, first_value(line) OVER (PARTITION BY file_id ORDER BY line_no) AS head FROM lines),
fold AS (SELECT file_id, pos, size AS running, 0 AS batch_no FROM sized WHERE pos = 0
  UNION ALL SELECT s.file_id, s.pos, CASE WHEN running + size > 120 THEN len({_TOKENS.format("head")}) + size ELSE running + size END,
  batch_no + CASE WHEN running + size > 120 THEN 1 ELSE 0 END FROM fold f JOIN sized s ON s.file_id = f.file_id AND s.pos = f.pos + 1),
packed AS (SELECT s.file_id, batch_no, min(s.pos) + 1 AS a, max(s.pos) + 1 AS b, any_value(head) AS head, string_agg(line, chr(10) ORDER BY s.pos) AS body
  FROM sized s JOIN fold f USING (file_id, pos) GROUP BY s.file_id, batch_no)
SELECT file_id, batch_no, 'Table 1, ' || CASE WHEN a = b THEN 'row ' || a ELSE 'rows ' || a || '-' || b END AS locator,
  md5(CASE WHEN batch_no > 0 THEN head || chr(10) ELSE '' END || body) AS digest FROM packed""",
    "b11_used_columns": f"WITH {_CELLS} SELECT * FROM used",
    "b12_header_rows": f"WITH {_CELLS} SELECT * FROM heads",
    "b13_sheet_rows": f"WITH {_CELLS} SELECT * FROM rows_",
    "b14_sheet_chunks": f"""
WITH RECURSIVE {_CELLS},
line AS (SELECT h.file_id, h.sheet, regexp_replace(array_to_string(vals, ' | '), '^[ |]+|[ |]+$', '', 'g') AS head,
  list_filter(vals, lambda x: x <> '') AS named FROM heads h JOIN texts t ON t.file_id = h.file_id AND t.sheet = h.sheet AND t.row_no = header_row),
sized AS (SELECT r.*, coalesce(head, '') AS head, coalesce(named, []) AS named, len({_TOKENS.format("text")}) AS size,
  len({_TOKENS.format("coalesce(head, '')")}) AS cost, row_number() OVER (PARTITION BY r.file_id, r.sheet ORDER BY row_no) AS pos FROM rows_ r LEFT JOIN line USING (file_id, sheet)),
fold AS (SELECT file_id, sheet, pos, cost + size AS running, 0 AS batch_no FROM sized WHERE pos = 1
  UNION ALL SELECT s.file_id, s.sheet, s.pos, CASE WHEN running + size > 60 THEN cost + size ELSE running + size END,
  batch_no + CASE WHEN running + size > 60 THEN 1 ELSE 0 END FROM fold f JOIN sized s ON s.file_id = f.file_id AND s.sheet = f.sheet AND s.pos = f.pos + 1),
packed AS (SELECT s.file_id, s.sheet, batch_no, min(row_no) AS a, max(row_no) AS b, any_value(head) AS head, any_value(named) AS named,
  string_agg(text, chr(10) ORDER BY row_no) AS body FROM sized s JOIN fold f USING (file_id, sheet, pos) GROUP BY s.file_id, s.sheet, batch_no)
SELECT file_id, sheet, batch_no, 'sheet ''' || sheet || ''', ' || CASE WHEN a = b THEN 'row ' || a ELSE 'rows ' || a || '-' || b END
  || CASE WHEN len(named) > 0 THEN ' (cols: ' || array_to_string(named[1:5], ' | ') || CASE WHEN len(named) > 5 THEN ' ...' ELSE '' END || ')' ELSE '' END AS locator,
  md5(CASE WHEN head <> '' THEN head || chr(10) ELSE '' END || body) AS digest FROM packed""",
    "b15_chunk_ids": f"""
WITH src AS (SELECT doc_id AS file_id, sha256(text) AS sha, text FROM documents), {_windows('src', 'file_id, sha')}
SELECT file_id, window_no, sha256(sha || window_no || substr(text, 1, 200)) AS chunk_id FROM chunk""",
    "b16_block_stats": f"""
WITH {_BLOCKS}
SELECT file_id, count(*) AS blocks, count(*) FILTER (NOT tab) AS paragraph_blocks, count(*) FILTER (tab) AS table_blocks,
  max(CASE WHEN tab THEN 1 ELSE 0 END) AS tables, count(DISTINCT CASE WHEN path <> '' THEN path END) AS headings, sum(length(trim(line))) AS chars
FROM loc GROUP BY file_id""",
    "b16_sheet_stats": f"""
WITH {_CELLS}, s AS (SELECT file_id, sheet, max(length(value)) > 12 AS f FROM cells GROUP BY 1, 2),
n AS (SELECT file_id, sheet, count(*) AS n FROM rows_ GROUP BY 1, 2)
SELECT file_id, count(*) AS sheets, coalesce(sum(n), 0) AS rows, bool_or(f) AS has_formulas, bool_and(f AND n IS NULL) AS formulas_without_values
FROM s LEFT JOIN n USING (file_id, sheet) GROUP BY file_id""",
    "c1_legible_ratio": """
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x09-\\x0D\\x20-\\x7E]', '', 'g')) / length(text) ELSE 1 END, 6) AS ratio FROM documents""",
    "c2_extraction_verdict": f"""
WITH {_QUALITY}
SELECT file_id, chars, round(cpp, 6) AS chars_per_page, round(ratio, 6) AS legible_ratio, quality, CASE WHEN quality = 'failed_no_text' THEN '{Q.NO_TEXT}'
  WHEN quality = 'ok' THEN '' WHEN cpp < 150 THEN 'Scanned pages produced only ' || printf('%.0f', cpp::DOUBLE) || ' characters per page on average (typical is over 1,500). The scan may be too faint, skewed, or low-resolution to read.'
  ELSE 'Only ' || printf('%.0f', ratio * 100) || '% of the recognised characters look like normal text, so the scan was probably misread. A clearer copy would give better results.' END AS quality_detail
FROM verdict""",
    "c3_ingest_outcome": f"""
WITH {_QUALITY}, n AS (SELECT doc_id AS file_id, len({_TOKENS.format("text")}) AS t FROM documents)
SELECT file_id, CASE WHEN t > 0 THEN greatest(t - 101, 0) // 600 + 1 ELSE 0 END AS chunk_count, quality, scanned IS NOT NULL AS was_reindexed
FROM verdict JOIN n USING (file_id) JOIN files USING (file_id)""",
    "c4_duplicate_uploads": f"""
WITH {_FILES}, k AS (SELECT matter_id, content_sha256, min(file_id) AS kept_file_id FROM files GROUP BY 1, 2)
SELECT matter_id, file_id, kept_file_id FROM files JOIN k USING (matter_id, content_sha256) WHERE file_id <> kept_file_id""",
    "c4_first_copies": "SELECT sha256(text) AS content_sha256, min(doc_id) AS kept_file_id, count(*) AS copies FROM documents GROUP BY 1",
    "c5_upload_actions": f"""
WITH {_FILES},
held AS (SELECT matter_id, content_sha256, min(file_id) FILTER (deleted_at IS NULL) AS live, min(file_id) FILTER (deleted_at IS NOT NULL) AS gone
  FROM files WHERE scanned IS NOT NULL GROUP BY 1, 2),
first AS (SELECT matter_id, content_sha256, min(file_id) AS f FROM files GROUP BY 1, 2)
SELECT matter_id, file_id + 1000000 AS upload_id, CASE WHEN live IS NOT NULL OR file_id <> f THEN 'duplicate' WHEN gone IS NOT NULL THEN 'restore' ELSE 'insert' END AS action,
  coalesce(live, gone) AS existing_file_id FROM files JOIN first USING (matter_id, content_sha256) LEFT JOIN held USING (matter_id, content_sha256)""",
    "c6_files_to_index": f"""
WITH {_FILES}, n AS (SELECT vec_id AS file_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT file_id, coalesce(n, 0) AS indexed FROM files LEFT JOIN n USING (file_id) WHERE n IS NULL OR coalesce(scanned, false)""",
    "c7_verify_written": """
SELECT doc_id AS file_id, count(vec_id) AS indexed, CASE WHEN count(vec_id) > 0 THEN 'ingested' ELSE 'failed_no_text' END AS ingest_status
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY doc_id""",
    "c8_latest_status": """
WITH s AS (SELECT user_id AS file_id, arg_max(event_id, (ts, event_id)) % 6 + 1 AS i FROM events GROUP BY 1)
SELECT file_id, (['ingested', 'ocr_low_quality', 'failed_no_text', 'password_protected', 'failed', 'pending'])[i] AS ingest_status, i IN (1, 2) AS queryable,
  (['Ready', 'Poor scan quality', 'No readable text', 'Password protected', 'Ingest failed', 'Not yet processed'])[i] AS label FROM s""",
    "c9_health": f"""
WITH {_HEALTH}
SELECT file_id, state, 'failed_no_text' AS ingest_status, CASE state WHEN 'missing' THEN 'Its search index is missing.' WHEN 'empty' THEN 'Its search index contains no text.'
  ELSE 'Its search index could not be read.' END || ' Re-upload this file to make it searchable again.' AS ingest_error FROM probed WHERE state <> 'ok'""",
    "c9_health_summary": f"WITH {_HEALTH} SELECT count(*) AS checked, count(*) FILTER (state <> 'ok') AS demoted FROM probed",
    "c10_files_to_reprocess": f"WITH {_FILES} SELECT file_id, ingest_status FROM files WHERE matter_id = 3 AND ingest_status = 'failed_no_text'",
}
