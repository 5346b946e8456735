"""Corpus scan: content hash and collection name per accepted file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file suffixes.
ACCEPTED_SUFFIXES = (".pdf", ".eml", ".docx", ".xlsx")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def collection_name(matter_id: Column, sha: Column) -> Column:
    """``m<matter>-<first 16 hex digits>``, or ``day1-...`` for a file outside any matter."""
    return F.concat(
        F.when(matter_id.isNull(), F.lit("day1-")).otherwise(F.concat(F.lit("m"), matter_id.cast("string"), F.lit("-"))),
        F.substring(sha, 1, 16),
    )


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


#: Larger files are not read: their bytes have to fit one row.
MAX_BYTES = 1 << 30
LISTED = "path string, modificationTime timestamp, length long, filename string, file_type string"


#: What opening a file counts beside its bytes when files are dealt to tasks; at Spark's 4 MB a task has four small files.
OPEN_BYTES = 1 << 15
#: Files of a folder that is listed at once: the driver holds their names.
FOLDER_FILES = 50_000


def _binary(spark: SparkSession, folder: str) -> DataFrame:
    dealing = spark.newSession()  # the cost belongs to these files, not to the caller's session
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            dealing.conf.set(key, value)
    dealing.conf.set("spark.sql.files.openCostInBytes", OPEN_BYTES)
    return dealing.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)


def write_texts(texts: DataFrame, folder: str, key: str, text: str, parts: int) -> list[str]:
    """Each key's texts as one file of lines, ``<key>=<value>`` in its path; returns the ``parts`` folders the files are dealt to.

    Keys are whole numbers. In a mounted folder tasks write the files themselves: Hadoop's local file system starts a process for each file it
    makes and moves a folder per file (40 ms a file). Other stores get Spark's writer.
    """
    folders = [f"{folder}/part={k}" for k in range(parts)]
    sc = texts.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    for f in folders:  # also those that get no file yet
        store.mkdirs(path(f))
    rows = texts.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), key, text).repartition(key)
    uri = store.makeQualified(path(folder)).toUri()
    top = uri.getPath() if uri.getScheme() == "file" else None
    if top is None:
        # Tasks move their own files: moved by the driver at the end, a folder per key is a call after the other.
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("part", key).text(folder)
        return folders

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        n = 0
        for n, ((part, value), lines) in enumerate(groupby(each, lambda r: r[:2]), 1):  # noqa: B007
            at = f"{top}/part={part}"
            # Renamed when whole, so that an attempt that is killed leaves none in part; a name with a dot isn't listed.
            with open(made := f"{at}/.{key}={value}.{os.getpid()}", "wb") as out:
                out.writelines(line.as_py() + b"\n" for _, _, line in lines)
            os.replace(made, f"{at}/{key}={value}.txt")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.withColumn(text, F.col(text).cast("binary")).sortWithinPartitions(key).mapInArrow(put, "n long").agg(F.sum("n")).first()
    return folders


def list_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Path, modification time, length, name and type of every file that isn't empty; no byte of the files is read."""
    name = F.element_at(F.split("path", "/"), -1)
    return _binary(spark, folder).select("path", "modificationTime", "length", name.alias("filename"), F.substring(suffix_of(name), 2, 10).alias("file_type"))


def new_files(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """Files not seen before, or changed since: path, time and length together tell."""
    return listed.join(seen.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti").select(*listed.columns)


def scan_files(spark: SparkSession, folder: str, files: DataFrame, matter_id: int | None = None, suffixes: tuple[str, ...] = ACCEPTED_SUFFIXES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """The accepted files among ``files`` (rows of ``list_corpus``) with the hash of their content, and the quarantine.

    Only files at least as new as the oldest wanted one are opened: the time goes down to the listing. A file that can't
    be read doesn't fail the scan; it is in the quarantine with its reason, as are too large and foreign ones.
    """
    reason = (
        F.when(~F.coalesce(F.concat(F.lit("."), "file_type"), F.lit("")).isin(*suffixes), "suffix").when(F.col("length") > max_bytes, "too large")
    )
    judged = files.withColumn("reason", reason)
    wanted = judged.filter("reason IS NULL").drop("reason")
    since = wanted.agg(F.min("modificationTime")).first()[0]
    read = _binary(spark, folder).filter((F.col("modificationTime") >= F.lit(since)) & (F.col("length") <= max_bytes))
    hashed = read.select("path", content_hash(F.col("content")).alias("content_sha256"))
    both = wanted.join(hashed, "path", "left")
    bad = both.filter("content_sha256 IS NULL").select(*files.columns, F.lit("unreadable").alias("reason"))
    matter = F.lit(matter_id).cast("long")
    good = both.filter("content_sha256 IS NOT NULL").select(
        matter.alias("matter_id"), "filename", "file_type", F.col("path").alias("stored_path"), "length", "content_sha256",
        collection_name(matter, F.col("content_sha256")).alias("collection"), F.col("modificationTime").alias("created_at"),
    )
    return good, judged.filter("reason IS NOT NULL").unionByName(bad)


def scan_corpus(spark: SparkSession, folder: str, matter_id: int | None = None) -> DataFrame:
    """One row per accepted file under ``folder``. Bytes are hashed in the scan and not kept."""
    return scan_files(spark, folder, list_corpus(spark, folder), matter_id)[0]
