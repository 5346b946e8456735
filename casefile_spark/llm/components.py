"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is an aggregate and a join on one end of the links; what it yields is written and read again, so lineage
stays short. Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

MAX_STEPS = 60


def _links(df: DataFrame) -> DataFrame:
    return df.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each end's larger neighbours are linked to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return _links(both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """Each end's smaller neighbours are linked to the smallest of them, and so is the end itself."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return _links(links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")))


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """``node``, ``root`` for every end of ``links`` (``a``, ``b``: longs); the root is the smallest node of its component."""
    now, seen = work.keep(_links(links), "links0"), None
    for step in range(1, MAX_STEPS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
        if not state["n"]:
            break
        now = work.keep(_small_star(work.keep(_large_star(now), f"large{step}")), f"links{step}")
        work.discard(f"large{step}", f"links{step - 1}")
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
