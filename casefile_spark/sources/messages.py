"""Messages: body choice, attachment names, normalised header and locator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_text, strip

NO_NAME = "(unnamed attachment)"


def _is_attachment() -> Column:
    return F.lower(F.coalesce("disposition", F.lit(""))) == "attachment"


def message_bodies(parts: DataFrame) -> DataFrame:
    """parts: msg_id, part_no, content_type, disposition, filename, content -> one body per message."""
    kind = F.lower(F.col("content_type"))
    priority = F.when(kind == "text/plain", 0).when(kind == "text/html", 1)
    offered = parts.filter(~_is_attachment()).withColumn("_p", priority)
    chosen = (
        offered.groupBy("msg_id")
        .agg(
            F.min_by("content", F.when(F.col("_p").isNotNull(), F.struct("_p", "part_no"))).alias("_content"),
            F.min("_p").alias("_kind"),
        )
    )
    body = F.when(F.col("_kind") == 0, strip(F.col("_content"))).when(F.col("_kind") == 1, html_to_text(F.col("_content")))
    every = parts.select("msg_id").distinct()
    return every.join(chosen, "msg_id", "left").select("msg_id", F.coalesce(body, F.lit("")).alias("body"))


def attachment_names(parts: DataFrame) -> DataFrame:
    """Names only, in part order; content is never read."""
    name = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit(NO_NAME))
    return (
        parts.filter(_is_attachment())
        .groupBy("msg_id")
        .agg(F.array_sort(F.collect_list(F.struct("part_no", name.alias("value")))).alias("_a"))
        .select("msg_id", F.transform("_a", lambda s: s["value"]).alias("attachments"))
    )


# Date header layouts, weekday removed.
DATE_LAYOUTS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")


def header_date(raw: Column) -> Column:
    """Calendar date as written in the header (its own offset), '' when it does not parse."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3,9},\s*|\s*\([^)]*\)\s*$", "")
    bare = F.regexp_replace(bare, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    wall = F.regexp_replace(bare, r"\s+[+-]\d{4}$", "")
    parsed = F.coalesce(*[F.try_to_timestamp(wall, F.lit(f)) for f in DATE_LAYOUTS[2:]])
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(""))


def message_headers(messages: DataFrame) -> DataFrame:
    """messages: msg_id, headers map<string,string> with lower-case names."""
    def header(name: str) -> Column:
        return F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))

    raw = header("from")
    bracketed = F.regexp_extract(raw, r"<([^<>]*)>", 1)
    display = F.trim(F.regexp_replace(F.regexp_extract(raw, r"^([^<]*)<", 1), r'^\s*"|"\s*$', ""))
    address = F.when(raw.contains("<"), F.trim(bracketed)).otherwise(
        F.when(raw.contains("@"), F.trim(raw)).otherwise(F.lit(""))
    )
    name = F.coalesce(F.nullif(display, F.lit("")), F.nullif(address, F.lit("")), raw)
    date_iso = header_date(header("date"))
    return messages.select(
        "msg_id",
        name.alias("sender_name"),
        address.alias("sender_email"),
        header("to").alias("to"),
        header("cc").alias("cc"),
        date_iso.alias("date_iso"),
        header("subject").alias("subject"),
        header("message-id").alias("message_id"),
        message_locator(name, date_iso).alias("locator"),
    )


def message_locator(sender: Column, date_iso: Column) -> Column:
    return F.concat(F.lit("from "), sender, F.when(date_iso != "", F.concat(F.lit(", "), date_iso)).otherwise(F.lit("")))
