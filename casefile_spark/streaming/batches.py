"""Stream output kept by micro-batch, so that a batch run again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType


def write_batch(folder: str, rows: DataFrame, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def start(df: DataFrame, mode: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Write all available input; append and update streams alike write only the rows of each batch."""
    return (
        df.writeStream.outputMode(mode).foreachBatch(lambda rows, batch: write_batch(folder, rows, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add("batch", LongType())).parquet(folder)


def latest(held: DataFrame, key: str) -> DataFrame:
    """The newest row per key; an update stream writes a key once per batch."""
    rest = [c for c in held.columns if c not in (key, "batch")]
    return held.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(key, "_row.*")
