"""Session helpers: settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and coalesces small ones; UTC keeps dates stable.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_session(master: str | None = None, app: str = "casefile", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """Use every core for row-local text work when the input has only a few splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task of row-local text work: seconds, not minutes.
TASK_ROWS = 100_000


def evenly(df: DataFrame, rows: int) -> DataFrame:
    """Deal about ``rows`` rows out to tasks of equal size, so that work per row neither ends in few tasks nor in a long one."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for job data under ``spark.checkpoint.dir``; local runs may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/casefile-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix=f"casefile-{name}-") + "/data"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed now and written once under ``shared_folder``, for what reads them several times."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
