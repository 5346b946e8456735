"""The given tables seen as casefile tables.

documents stand for files and their text, ``source`` for the matter, labels for quality flags,
embeddings for chunk vectors with ``label`` as collection, conversations for messages, events for
logs and heartbeats, orders / lineitem / customer for the ledger, part for the model catalogue,
region / nation / supplier for tiers, courts and cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.generate import explode_rows
from ..session import spread
from ..sources.files import collection_name, content_hash

AS_OF = "2024-02-01 00:00:00"
LEDGER_AS_OF = "2000-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in ("documents", "pages"):
        df = spread(df)
    local = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def matter_of(source):
    return F.regexp_extract(source, r"(\d+)$", 1).cast("long")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents with labels: status, soft deletion (toxic) and content hash per file."""
    d = table(spark, sf, "documents")
    flags = table(spark, sf, "labels")
    sha = content_hash(F.col("text"))
    status = (
        F.when(F.length("text") < 200, "failed_no_text")
        .when(F.col("quality") == 0, "ocr_low_quality")
        .otherwise("ingested")
    )
    deleted = F.when(
        F.col("toxic") == 1, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.col("doc_id") * 3600)
    )
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int") % 1500), "yyyy-MM-dd")
    return d.join(flags, "doc_id", "left").select(
        F.col("doc_id").alias("file_id"),
        matter_of(F.col("source")).alias("matter_id"),
        F.when(F.col("lang") == "en", F.concat(day, F.lit(" - "), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx"))).alias("filename"),
        sha.alias("content_sha256"),
        collection_name(matter_of(F.col("source")), sha).alias("collection"),
        status.alias("ingest_status"),
        deleted.alias("deleted_at"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2023-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60).alias("created_at"),
        F.col("lang").alias("lang"),
        (F.col("quality") == 0).alias("scanned"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), matter_of(F.col("source")).alias("matter_id"), "source", "lang", "text"
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of every document, numbered from 0."""
    return explode_rows(texts(spark, sf), ["file_id", "matter_id"], F.split("text", "\n", -1), "line", "line_no")


def vectors_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table over embeddings, with passage columns from the document of the same id."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
        F.col("label").alias("collection_pos"),
        F.col("vec_id").alias("chunk_no"),
        F.col("vec_id").cast("string").alias("chunk_key"),
        "embedding",
    )


def centroid_queries(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """One query per collection: the mean of its vectors."""
    c = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select(F.col("label").cast("long").alias("query_id"), F.lit(k).alias("k"), "embedding")


def collection_of(source, lang):
    return F.concat(source, F.lit("-"), lang)


def collection_order(source, lang):
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return F.regexp_extract(source, r"(\d+)$", 1).cast("int") * 10 + F.array_position(langs, lang).cast("int")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table: vectors with their document, one collection per source and language."""
    d = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return e.join(d, "doc_id").select(
        collection_of(F.col("source"), F.col("lang")).alias("collection"),
        collection_order(F.col("source"), F.col("lang")).alias("collection_pos"),
        F.col("doc_id").alias("chunk_no"),
        F.col("doc_id").cast("string").alias("chunk_key"),
        "embedding",
        F.concat("source", F.lit(".pdf")).alias("source"),
        F.concat(F.lit("p."), F.length("text").cast("string")).alias("locator"),
        "text",
    )


def requested(spark: SparkSession, sf: str) -> DataFrame:
    """Collections each query asks for: every pairing that occurs among the documents."""
    d = table(spark, sf, "documents")
    return d.select(
        (F.col("doc_id") % 10).alias("query_id"),
        collection_of(F.col("source"), F.col("lang")).alias("collection"),
        collection_order(F.col("source"), F.col("lang")).alias("collection_pos"),
    ).distinct()


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("from "), F.col("role"), F.lit(", turn "), F.col("turn").cast("string")).alias("locator"),
    )


# --- ledger ----------------------------------------------------------------------------------
def matters(spark: SparkSession, sf: str) -> DataFrame:
    """customers as matters: negative balance = soft-deleted; one segment was purged entirely."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "FURNITURE")
    start = F.unix_timestamp(F.lit("1999-12-31 12:00:00").cast("timestamp"))
    return c.select(
        F.col("c_custkey").alias("matter_id"),
        F.col("c_name").alias("name"),
        F.timestamp_seconds(start - F.col("c_custkey") * 3600).alias("created_at"),
        F.when(F.col("c_nationkey") > 12, F.timestamp_seconds(start - F.col("c_nationkey") * 86400)).alias("last_queried_at"),
        F.when(F.col("c_acctbal") < 0, F.timestamp_seconds(start - F.col("c_custkey") * 7200)).alias("deleted_at"),
    )


def task_costs(spark: SparkSession, sf: str) -> DataFrame:
    """orders as ledger rows: pending orders have an unknown cost, low priority has no matter."""
    o = table(spark, sf, "orders")
    low = F.col("o_orderpriority") == "5-LOW"
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(~low, F.col("o_custkey")).alias("matter_id"),
        F.when(~low & (F.col("o_orderpriority") != "4-NOT SPECIFIED"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("matter_name"),
        F.lower("o_orderpriority").alias("task_id"),
        F.concat(F.lit("model-"), F.lower("o_orderstatus")).alias("model_used"),
        F.floor("o_totalprice").cast("long").alias("input_tokens"),
        F.floor(F.col("o_totalprice") / 10).cast("long").alias("output_tokens"),
        F.when(
            F.col("o_orderstatus") != "P", (F.floor("o_totalprice").cast("decimal(11,0)") * F.expr("0.000001BD")).cast("decimal(18,6)")
        ).alias("cost_usd"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.floor(F.col("o_totalprice")) / 8).alias("duration_seconds"),
        (F.col("o_orderstatus") == "F").alias("was_exhaustive"),
        F.when(F.col("o_orderstatus") == "O", "failed").otherwise("completed").alias("status"),
        F.col("o_orderkey").cast("string").alias("run_id"),
    )


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as model calls of a run: an undiscounted call reports no cost."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        F.concat(F.lit("model-"), F.lower("l_returnflag")).alias("model"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.floor("l_extendedprice").cast("long").alias("output_tokens"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost_usd"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as run heartbeats: user = run; purchase ends it, error fails it, the rest is running."""
    status = (
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "queued").otherwise("running")
    )
    return events(spark, sf).select(
        F.col("user_id").cast("string").alias("run_id"), (F.col("user_id") % 10).alias("matter_id"),
        status.alias("status"), F.col("ts").alias("at"), "event_id",
    )


# --- sheets and catalogues -------------------------------------------------------------------
def cells(spark: SparkSession, sf: str) -> DataFrame:
    """part as sheets: one workbook per size, one sheet per type, one row per part, seven columns."""
    p = table(spark, sf, "part")
    row = F.row_number().over(Window.partitionBy("p_size", "p_type").orderBy("p_partkey"))
    shown = F.array(
        F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"),
        F.format_string("%.2f", "p_retailprice"), F.lit(""), F.when(F.col("p_brand") == "Brand#7", "x").otherwise(""),
    )
    return (
        p.withColumn("row_no", row)
        .select(F.col("p_size").alias("file_id"), F.col("p_type").alias("sheet"), "row_no", F.posexplode(shown).alias("_c", "value"))
        .select("file_id", "sheet", "row_no", (F.col("_c") + 1).alias("col_no"), "value")
    )


def raw_models(spark: SparkSession, sf: str) -> DataFrame:
    """part as a price catalogue in the provider's raw form: decimal strings per token."""
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lower("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.struct(
            (F.col("p_retailprice") / 1e8).cast("string").alias("prompt"),
            (F.col("p_size") / 1e7).cast("string").alias("completion"),
        ).alias("pricing"),
        (F.col("p_size") * 1000).alias("context_length"),
    )
