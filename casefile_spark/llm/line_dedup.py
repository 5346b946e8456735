"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes to the leaf of its token count and leading tokens, tokens with digits being fields
from the start. In a leaf a token that enough documents' lines have at its place is part of the template, any other is a
field. Lines are dropped when documents enough share their template and enough of it is not field.

Lines meet as distinct texts with their number of documents, so a line in a third of all documents is one row, and only
leaves that recur across documents are looked at token by token. Token rows carry the line's number and the leaf's digest,
never the line, so a line of 200,000 characters is as light as any. What is counted are documents: where one has several
lines of a leaf, those beyond the first that agree in what is counted are taken off again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .storage import Workspace

MIN_DOCS = 5
DEPTH = 3
CONSTANT = 0.5
FIELD = "<*>"
SPACES = r"[\x20\x09\x0B-\x0D]+"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACES), lambda t: t != "")


def _leaf(tokens: Column) -> Column:
    """Token count and leading tokens, with fields for tokens that hold a digit."""
    lead = F.transform(F.slice(tokens, 1, DEPTH), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return F.concat_ws(" ", F.size(tokens).cast("string"), lead)


def _digest(leaf: Column) -> Column:
    return F.unhex(F.md5(leaf.cast("binary")))


def _begins(line: Column) -> Column:
    """The first token, a field if it holds a digit: lines of one leaf agree in it."""
    token = F.regexp_extract(line, r"[^\x20\x09\x0B-\x0D]+", 0)
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _repeated(items: Column) -> Column:
    """Values that an array holds twice or more."""
    return let(F.array_sort(items), lambda ordered: F.array_distinct(F.filter(ordered, lambda x, i: x == F.get(ordered, i - 1))))


def _once(rows: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """A generator of one row: what it makes isn't computed again for every use and every filter above it."""
    return rows.select(*keep, F.explode_outer(F.array(value)).alias(name))


def _several(docs: DataFrame) -> DataFrame:
    """``key``, ``leaf``, ``line`` of the distinct lines of documents that have two or more in one leaf; found row by row.

    Only lines that begin like another one of their document are cut into tokens.
    """
    lines = _once(docs.select(F.monotonically_increasing_id().alias("key"), "text"), ["key"], F.array_distinct(F.split("text", "\n")), "lines").filter(F.size("lines") > 1)
    begun = _once(lines, ["key", "lines"], F.transform("lines", _begins), "begun")
    again = _once(begun, ["key", "lines", "begun"], _repeated(F.filter("begun", lambda b: b != "")), "again").filter(F.size("again") > 0)
    alike = F.filter("lines", lambda x, i: F.array_contains("again", F.get("begun", i)))  # few values each
    leafed = _once(again, ["key"], F.transform(alike, lambda x: F.struct(_leaf(_tokens(x)).alias("leaf"), x.alias("line"))), "leafed")
    twice = _once(leafed, ["key", "leafed"], _repeated(F.col("leafed")["leaf"]), "twice").filter(F.size("twice") > 0)
    rows = twice.select("key", F.explode(F.filter("leafed", lambda x: F.array_contains("twice", x["leaf"]))).alias("x"))
    return rows.select("key", _digest(F.col("x.leaf")).alias("leaf"), "x.line")


def _documents(lines: DataFrame, several: DataFrame, *by: str) -> DataFrame:
    """The number ``n`` of documents by ``by``: those of the lines, less the further lines of documents counted already."""
    further = several.groupBy("key", *by).agg((1 - F.count("*")).alias("docs")).filter("docs < 0")
    return lines.select(*by, "docs").unionByName(further.select(*by, "docs")).groupBy(*by).agg(F.sum("docs").alias("n"))


def _words(lines: DataFrame, *keep: str) -> DataFrame:
    tokens = lines.select(*keep, F.posexplode(_tokens(F.col("line"))).alias("place", "token"))
    return tokens.withColumn("token", F.when(F.col("token").rlike("[0-9]"), F.lit(FIELD)).otherwise(F.col("token")))


def templates(docs: DataFrame, work: Workspace, min_docs: int = MIN_DOCS) -> DataFrame:
    """``line``, ``template``, ``docs`` of the distinct lines whose template stands in ``min_docs`` documents or more."""
    lines = docs.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = _once(lines.groupBy("line").agg(F.count("*").alias("docs")), ["line", "docs"], _tokens(F.col("line")), "tokens").filter(F.size("tokens") > 0)
    lines = lines.select(F.monotonically_increasing_id().alias("id"), "line", "docs", F.size("tokens").alias("size"), _digest(_leaf(F.col("tokens"))).alias("leaf"))
    lines = work.keep(lines, "lines")
    several = work.keep(_several(docs), "several")
    work.drop()
    leaves = work.keep(_documents(lines, several, "leaf").filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    live = work.keep(lines.join(leaves, "leaf"), "live")
    work.drop("lines")
    tokens = _words(live, "id", "leaf", "docs")
    fixed = _words(several.join(leaves, "leaf"), "key", "leaf").filter(F.col("token") != FIELD)
    common = _documents(tokens.filter(F.col("token") != FIELD), fixed, "leaf", "place", "token").filter(F.col("n") >= min_docs)
    common = work.keep(common.select("leaf", "place", "token", F.lit(True).alias("constant")), "constants")
    work.drop("leaves")
    marked = tokens.drop("docs").join(common, ["leaf", "place", "token"])
    # Only constants travel on; the other places of a line are fields, and its row knows how many there are.
    found = marked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("words"))
    shaped = live.select("id", "line", "docs", "size").join(found, "id").filter(F.size("words") >= CONSTANT * F.col("size"))
    shaped = work.keep(shaped.select("line", "docs", "size", "words"), "shaped")
    work.drop("live", "constants")
    places = F.transform("words", lambda w: F.concat(w["place"].cast("string"), F.lit(" "), w["token"]))
    shaped = shaped.withColumn("template", F.concat_ws(" ", F.concat(F.col("size").cast("string"), F.lit(":")), places))
    alike = several.join(shaped.select("line", "template"), "line")
    recurring = _documents(shaped, alike, "template").filter(F.col("n") >= min_docs).select("template")
    return shaped.join(recurring, "template").select("line", "template", "docs")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_lines``, ``n_dropped``, ``kept_text``.

    Lines end at line feeds. A line that recurs in one document counts once for it; rows that repeat an id count as
    documents of their own. Blank lines are never dropped. A null text has no lines, an empty one has one. Columns other
    than ``doc_id`` and ``text`` are not read.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = rows.filter("text is not null")
    gone = work.keep(templates(known, work, min_docs).select("line"), "gone")
    hits = known.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).join(gone, "line")
    work.drop("shaped", "several")
    hits = work.keep(hits.groupBy("doc_id").agg(F.collect_set("line").alias("gone")).withColumnRenamed("doc_id", "d"), "hits")
    work.drop("gone")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("gone", x), F.lit(False)))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")), "left")
    out = out.select("doc_id", F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.when(F.col("gone").isNull(), lines).otherwise(kept).alias("kept"), "text")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines"))
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_dropped"), F.when(F.col("text").isNotNull(), F.concat_ws("\n", "kept")).alias("kept_text"))
