"""Chunk index of immutable versions: a write adds folders, and one small commit file makes it visible.

``data/write=<id>`` holds chunks by matter and file bucket, ``gone`` tombstones of files that the write replaced or removed,
``contents`` one row per file by content bucket, ``filters`` Bloom filters of its files and contents.
``commits/<version>.json`` lists the writes that make up a version. It is written aside and renamed into place, which fails
when that version exists, so of two writers one has to begin again. A reader resolves the newest commit once: what a write
does meanwhile, or has left behind after a failure, is not seen. A tombstone hides rows of earlier writes, so replacing or
purging files rewrites nothing; ``compact`` merges the newest writes and ``vacuum`` deletes folders that no kept version lists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import membership

FILE = ["matter_id", "file_id"]
_FILE_TYPES = "matter_id long, file_id long"
_CONTENT = f"{_FILE_TYPES}, content_sha256 string, write string, content_bucket int"
_GONE = f"{_FILE_TYPES}, write string"
_FILTERS = f"kind string, {membership.FILTER}"


class IndexChanged(RuntimeError):
    """Another writer has committed since this one began."""


class ChunkIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # -- files and commits --------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path("commits")
        if not self._fs().exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The writes of a version (the newest one by default), oldest first, each with its number and schema."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "writes": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/commits/{version:012}.json", wholetext=True).collect()))

    def _commit(self, version: int, writes: list[dict]) -> int:
        fs, jvm = self._fs(), self.spark._jvm
        aside, final = self._path("commits", f".{uuid.uuid4().hex}"), self._path("commits", f"{version:012}.json")
        out = fs.create(aside)
        out.write(bytearray(json.dumps({"version": version, "writes": writes}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        keep_existing = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, final, keep_existing)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(final):
                raise IndexChanged(f"version {version} exists") from e
            raise
        return version

    # -- reading ------------------------------------------------------------------------------
    def _folders(self, kind: str, writes: list[dict]) -> list[str]:
        return [f"{self.folder}/{kind}/write={w['id']}" for w in writes if kind in w["kinds"]]

    def _table(self, kind: str, writes: list[dict], schema: StructType | str) -> DataFrame:
        folders = self._folders(kind, writes)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*folders)

    def _live(self, rows: DataFrame, writes: list[dict]) -> DataFrame:
        """Rows that no later write's tombstone hides."""
        numbers = F.broadcast(self.spark.createDataFrame([(w["id"], w["number"]) for w in writes], "write string, _number long"))  # a row a write
        if not self._folders("gone", writes):
            return rows.drop("write")
        gone = self._table("gone", writes, _GONE).join(numbers, "write").groupBy(*FILE).agg(F.max("_number").alias("_gone"))
        held = rows.join(numbers, "write").join(gone, FILE, "left").filter(F.col("_gone").isNull() | (F.col("_number") >= F.col("_gone")))
        return held.drop("write", "_number", "_gone")

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks of a version."""
        return self._read(self.manifest(version)["writes"])

    def _read(self, writes: list[dict]) -> DataFrame:
        fields = {}
        for w in writes:
            for field in StructType.fromJson(w["schema"]).fields if "data" in w["kinds"] else []:
                fields.setdefault(field.name, field)
        if not fields:
            return self.spark.createDataFrame([], f"{_FILE_TYPES}, chunk_index int, file_bucket int")
        return self._live(self._table("data", writes, StructType([*fields.values()]).add("write", "string")), writes)

    def buckets_to_read(self, contents: DataFrame, writes: list[dict]) -> list[int]:
        """Content buckets that may hold any of the contents; at most ``buckets`` numbers."""
        filters = self._table("filters", writes, _FILTERS).filter(F.col("kind") == "content")
        maybe = membership.probe(filters, contents.select(membership.key_hash("matter_id", "content_sha256").alias("key")), self.buckets)
        return sorted(r[0] for r in maybe.select("bucket").distinct().collect())

    def holders(self, contents: DataFrame) -> DataFrame:
        """``matter_id``, ``content_sha256``, ``file_id`` of live files that hold any of the given contents (matter_id, content_sha256).

        Filters rule out most contents that are new; only the buckets of the others are read, and compared exactly.
        """
        writes = self.manifest()["writes"]
        buckets = self.buckets_to_read(contents, writes)
        held = self._table("contents", writes, _CONTENT).filter(F.col("content_bucket").isin(buckets) if buckets else F.lit(False))
        return self._live(held, writes).join(contents.select("matter_id", "content_sha256").distinct(), ["matter_id", "content_sha256"]).select("matter_id", "content_sha256", "file_id")

    # -- writing ------------------------------------------------------------------------------
    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("file_bucket", F.pmod(F.xxhash64("file_id"), F.lit(self.buckets)).cast("int"))

    def _put(self, kind: str, write: str, rows: DataFrame, *by: str) -> DataFrame:
        rows.write.partitionBy(*by).parquet(f"{self.folder}/{kind}/write={write}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{kind}/write={write}")

    def write(self, chunks: DataFrame | None = None, gone: DataFrame | None = None, write_id: str | None = None) -> int:
        """Replace the chunks of the files in ``chunks``, remove the files in ``gone`` (matter_id, file_id); the new version's number.

        A ``write_id`` that is committed already changes nothing, so a micro-batch can be delivered again.
        """
        held = self.manifest()
        if write_id and any(write_id in w["names"] for w in held["writes"]):
            return held["version"]
        write, kinds, schema = uuid.uuid4().hex, ["gone"], None
        stones = gone.select(*FILE) if gone is not None else self.spark.createDataFrame([], _FILE_TYPES)
        if chunks is not None:
            named = chunks if "content_sha256" in chunks.columns else chunks.withColumn("content_sha256", F.lit(None).cast("string"))
            rows = self._bucketed(chunks)
            rows = rows.hint("rebalance", "matter_id", "file_bucket").sortWithinPartitions("matter_id", "file_bucket", "file_id", "chunk_index")
            self._put("data", write, rows, "matter_id", "file_bucket")
            files = named.groupBy(*FILE).agg(F.first("content_sha256", ignorenulls=True).alias("content_sha256"))
            content = membership.key_hash("matter_id", "content_sha256")
            files = files.withColumn("content_bucket", membership.bucket_of(content, self.buckets))
            files = self._put("contents", write, files.hint("rebalance", "content_bucket"), "content_bucket")
            kinds += ["data", "contents", "filters"]
            schema = rows.schema.jsonValue()
            self._write_filters(files, write)
            filters = self._table("filters", held["writes"], _FILTERS).filter(F.col("kind") == "file")
            fresh = files.select(*FILE, membership.key_hash(*FILE).alias("key"))
            maybe = membership.probe(filters, fresh, self.buckets)
            stones = stones.unionByName(fresh.join(maybe.select("key"), "key", "left_semi").select(*FILE))
        self._put("gone", write, stones.distinct())
        version = held["version"] + 1
        entry = {"id": write, "names": [write_id] if write_id else [], "number": version, "kinds": kinds, "schema": schema}
        return self._commit(version, [*held["writes"], entry])

    def _write_filters(self, files: DataFrame, write: str) -> None:
        of_files = membership.build(files.select(membership.key_hash(*FILE).alias("key")), self.buckets).select(F.lit("file").alias("kind"), "*")
        of_contents = membership.build(files.select(membership.key_hash("matter_id", "content_sha256").alias("key")), self.buckets).select(F.lit("content").alias("kind"), "*")
        self._put("filters", write, of_files.unionByName(of_contents))

    def compact(self, newest: int | None = None) -> int:
        """Merge the ``newest`` writes (all by default) to one; older writes stay as they are and hidden rows are dropped."""
        held = self.manifest()
        split = max(0, len(held["writes"]) - (newest if newest is not None else len(held["writes"])))
        older, merged = held["writes"][:split], held["writes"][split:]
        if not merged:
            return held["version"]
        write = uuid.uuid4().hex
        rows = self._read(merged)
        self._put("data", write, rows.hint("rebalance", "matter_id", "file_bucket").sortWithinPartitions("matter_id", "file_bucket", "file_id", "chunk_index"), "matter_id", "file_bucket")
        files = self._live(self._table("contents", merged, _CONTENT), merged)
        self._write_filters(self._put("contents", write, files.hint("rebalance", "content_bucket"), "content_bucket"), write)
        self._put("gone", write, self._table("gone", merged if older else [], _GONE).select(*FILE).distinct())
        names = [n for w in merged for n in w["names"]]
        entry = {"id": write, "names": names, "number": merged[-1]["number"], "kinds": ["gone", "data", "contents", "filters"], "schema": rows.schema.jsonValue()}
        return self._commit(held["version"] + 1, [*older, entry])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete commits before the newest ``keep`` and folders that none of those lists; readers of older versions must be done."""
        kept = self.versions()[-keep:]
        listed = {f"write={w['id']}" for v in kept for w in self.manifest(v)["writes"]}
        fs, dropped = self._fs(), []
        for version in self.versions()[:-keep]:
            fs.delete(self._path("commits", f"{version:012}.json"), False)
        for kind in ("data", "gone", "contents", "filters"):
            for status in fs.listStatus(self._path(kind)) if fs.exists(self._path(kind)) else []:
                if status.getPath().getName() not in listed:
                    dropped.append(f"{kind}/{status.getPath().getName()}")
                    fs.delete(status.getPath(), True)
        return dropped
