"""Intermediate tables of one job, in the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


class Workspace:
    """Tables written between the steps of a job: they cut lineage, and every executor can read them again after a loss."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, shared_folder(spark, name)

    def path(self, part: str) -> str:
        return f"{self.base}/{part}"

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(part))
        return self.spark.read.schema(df.schema).parquet(self.path(part))

    def discard(self, *parts: str) -> None:
        """Delete tables that nothing reads any more."""
        sc = self.spark.sparkContext
        for part in parts:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.path(part))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *parts: str) -> None:
        """``discard``, and let Spark's cleaner remove the shuffle files of finished steps."""
        self.discard(*parts)
        sc = self.spark.sparkContext
        for _ in range(2):
            gc.collect()
            sc._jvm.System.gc()
            time.sleep(0.3)  # the cleaner works in a thread of its own


def partitions_for(df: DataFrame, size: float, target: float) -> int:
    """Partitions of about ``target`` for ``size`` bytes or rows, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // target) + 1)


#: Ids that are broadcast at most (8 bytes each, under 20 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, column: str, kept: bool) -> DataFrame:
    """The rows whose ``doc_id`` is among the ids, or those whose isn't. ``ids`` is a written table, counted to choose the join."""
    side = ids.select(F.col(column).alias("__id"))
    if side.count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return rows.join(side, rows["doc_id"] == side["__id"], "left_semi" if kept else "left_anti")
