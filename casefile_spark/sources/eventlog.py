"""Append-only JSON-lines event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(events: DataFrame, folder: str) -> None:
    """One JSON object per line: timestamp, event and whatever else the row carries."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parse each line; lines that are no JSON object are kept with ``malformed`` set."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    full = f"{schema}, _bad string"
    parsed = lines.filter(F.trim(F.col(column)) != "").withColumn("_e", F.from_json(F.col(column), full, opts))
    return parsed.withColumn("malformed", F.col("_e").isNull() | F.col("_e._bad").isNotNull()).drop(column)


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    parsed = parse_lines(spark.read.text(folder), schema)
    return parsed.select("_e.*", "malformed").drop("_bad")


def log_counts(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count_if(~F.col("malformed")).alias("scanned"), F.count_if(F.col("malformed")).alias("malformed")
    )
