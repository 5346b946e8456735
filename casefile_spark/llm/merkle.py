"""Merkle manifest of a dataset with nested-interval labels: every node carries the interval of leaf ranks that it covers.

Leaves are ranked per group by a range sort; a node of level k covers 16**k ranks, so its label follows from its place. Going
up, each level is one aggregate of at most 16 children a key. Going down, nodes meet their ancestors in a containment join,
bucketed by level: a child's interval lies in its parent's, and the intervals of the parent that differ from the child's own
are its siblings. A path is a list of (siblings before, siblings after) from a node to the root, and folding it gives the root.

The path above a node is joined once for each node, and only the last step, inside one row of 16 leaves, repeats it for each leaf.
A group with a third of all rows is cut by rank like any other; the ranks come from partition counts, so no task sorts a group.

Nulls: a null field is ``-``, a null group comes first and is a group of its own, null keys come first. Rows of equal key are
ordered by their digests, and equal rows are leaves of their own. Texts are hashed whole. Other columns are ignored. An empty
table has no rows and no root.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, partitions_for

FAN = 16
RANK_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "struct<lo: bigint, hi: bigint, digest: string>"
_PATH = "array<struct<before: string, after: string>>"


def record_digest(*fields: Column) -> Column:
    """SHA-256 in hex of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined_digest(digests: Column) -> Column:
    """SHA-256 of hex digests one after the other."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ranked(rows: DataFrame, group: str | None, order: list[str], work: Workspace, name: str) -> DataFrame:
    """Adds ``rank`` (from 0) within the group in the order of the columns (nulls first), and ``size``, the group's rows.

    Rows are sorted by ranges; a row's place in its task and the counts of the tasks before give its place overall.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    tasks = partitions_for(rows, rows.count(), RANK_ROWS)
    placed = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = work.keep(placed, f"{name}-placed")
    pid, local = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(pid.alias("pid")).count()
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    counts = work.keep(counts.select("pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), f"{name}-tasks")
    overall = placed.join(F.broadcast(counts), pid == F.col("pid")).withColumn("at", local + F.col("before")).drop("pid", "before")
    if not group:
        return overall.withColumnRenamed("at", "rank").withColumn("size", F.lit(placed.count()))
    grouped = overall.groupBy(F.col(group).alias("_group")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    grouped = work.keep(grouped, f"{name}-groups")
    both = overall.join(grouped, F.col(group).eqNullSafe(F.col("_group")))
    return both.withColumn("rank", F.col("at") - F.col("first")).drop("at", "first", "_group")


def grow(leaves: DataFrame, group: str, work: Workspace, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels above the leaves (``group``, ``rank``, ``size``, ``digest``), each node with its label, digest and children;
    and the top node of every group: ``group``, ``level``, ``digest``.

    Level k of a group of n leaves exists when n > 16**(k - 1), so nodes that remain alone go no further.
    """
    now = leaves.select(group, "size", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    largest = leaves.agg(F.max("size")).first()[0] or 0
    levels, tops, width = [], now.filter("size = 1").select(group, F.lit(0).alias("level"), "digest"), 1
    while largest > width:
        child = F.struct("lo", "hi", "digest")
        up = now.filter(F.col("size") > width).groupBy(group, "size", F.floor(F.col("lo") / (width * FAN)).alias("bucket"))
        up = up.agg(F.array_sort(F.collect_list(child)).alias("children"))
        up = up.select(group, "size", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), joined_digest(F.col("children")["digest"]).alias("digest"), "children")
        width *= FAN
        levels.append(work.keep(up, f"{name}-level{len(levels) + 1}"))
        now = levels[-1].drop("children")
        tops = tops.unionByName(now.filter((F.col("size") > width // FAN) & (F.col("size") <= width)).select(group, F.lit(len(levels)).alias("level"), "digest"))
    return levels, work.keep(tops, f"{name}-tops")


def descend(levels: list[DataFrame], group: str, tops: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Every leaf's ``group``, ``lo`` and ``path`` to the root; ``tops`` has the path of each group's top node (``group``, ``level``, ``path``)."""
    above = tops.select(F.col(group).alias("_group"), F.col("level").alias("_level"), F.col("path").alias("_path"))
    same = F.col(group).eqNullSafe(F.col("_group"))
    reached = None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        starts = nodes.join(above.filter(F.col("_level") == level), same).select(group, "lo", "hi", "children", F.col("_path").alias("path"))
        if reached is not None:
            width = FAN**level
            parent = reached.select(F.col(group).alias("_group"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("_path"))
            inside = (F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width)) & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
            starts = starts.unionByName(nodes.join(parent, same & inside).select(group, "lo", "hi", "children", F.col("_path").alias("path")))
        each = starts.select(group, "path", "children", F.inline("children"))
        reached = work.keep(each.select(group, "lo", "hi", "digest", with_siblings(F.col("children"), F.col("path")).alias("path")), f"{name}-paths{level}") if level > 1 else starts
    return reached


def with_siblings(children: Column, path: Column) -> Column:
    """The path of the child ``lo``, ``hi``: intervals of its parent's children before and after its own, then the parent's path."""
    before = F.filter(children, lambda x: x["hi"] < F.col("lo"))
    after = F.filter(children, lambda x: x["lo"] > F.col("hi"))
    step = F.struct(F.array_join(before["digest"], "").alias("before"), F.array_join(after["digest"], "").alias("after"))
    return F.concat(F.array(step), path)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return joined_digest(F.transform(path, lambda step: F.concat(step["before"], step["after"])))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source") -> DataFrame:
    """A row per record: ``key``, ``leaf``, ``subroot`` (of its group), ``root``, ``path``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``tampered`` gives fields other values; the root is then folded from the leaf of these values and the siblings of the
    manifest, so a changed record isn't verified.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "merkle")
    now = [(tampered or {}).get(c, F.col(c)) for c in fields]
    leaves = docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), record_digest(*[F.col(c) for c in fields]).alias("digest"),
        record_digest(*now).alias("seen"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = work.keep(leaves, "leaves")
    leaves = work.keep(ranked(leaves, "grp", ["key", "digest", "row"], work, "leaf"), "ranked")
    work.drop("leaves", "leaf-placed")
    levels, tops = grow(leaves, "grp", work, "leaf")

    subroots = ranked(tops.select("grp", F.col("level").alias("height"), F.col("digest").alias("subroot")), None, ["grp"], work, "group")
    subroots = work.keep(subroots.withColumn("all", F.lit("")).withColumn("digest", F.col("subroot")), "subroots")
    upper, roots = grow(subroots, "all", work, "group")
    none = F.array().cast(_PATH)
    ended = _leaf_paths(subroots, upper, "all", roots.withColumn("path", none), work, "group")
    starts = work.keep(ended.join(F.broadcast(roots.select("all", F.col("digest").alias("root"))), "all").select("grp", F.col("height").alias("level"), "subroot", "root", "path"), "starts")  # one root

    found = _leaf_paths(leaves, levels, "grp", starts.select("grp", "level", "path"), work, "leaf")
    names = starts.select(F.col("grp").alias("_grp"), "subroot", "root")
    found = found.join(names, F.col("grp").eqNullSafe(F.col("_grp")))
    folded = found.withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return folded.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _leaf_paths(leaves: DataFrame, levels: list[DataFrame], group: str, tops: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The leaves with their ``path``: leaves of one parent are one row until the path is known, so it is joined once for them."""
    alone = leaves.filter("size = 1").join(tops.select(F.col(group).alias("_group"), "path"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    if not levels:
        return alone
    parents = descend(levels, group, tops, work, name).select(F.col(group).alias("_group"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "children", "path")
    own = [c for c in leaves.columns if c not in (group, "size")]
    runs = leaves.filter("size > 1").groupBy(group, "size", F.floor(F.col("rank") / FAN).alias("bucket")).agg(F.collect_list(F.struct(*own)).alias("own"))
    inside = (F.col("bucket") == F.floor(F.col("_lo") / FAN)) & (F.col("bucket") * FAN >= F.col("_lo")) & (F.col("bucket") * FAN <= F.col("_hi"))
    each = runs.join(parents, F.col(group).eqNullSafe(F.col("_group")) & inside).select(group, "size", "children", "path", F.inline("own"))
    each = each.withColumns({"lo": F.col("rank"), "hi": F.col("rank")})
    return alone.unionByName(each.withColumn("path", with_siblings(F.col("children"), F.col("path"))).select(*alone.columns))
