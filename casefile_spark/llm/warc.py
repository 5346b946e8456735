"""WARC archives, index first: while records are written, one index row per record tells file, offset, length, URL and
digest; readers take the index rows they want, sorted by offset, and merge neighbours into a few byte-range reads.

Each record is a gzip member of its own, so a byte range of the index is all that is needed to read it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, partitions_for

LEAST_REVISIT_BYTES = 100
FILE_BYTES = 1 << 30
SPAN_BYTES = 16 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"

_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])
_INDEX_DDL = "file string, offset long, length long, url string, page_id long, payload_digest string, record_type string"
_RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response holds HTTP headers and payload, a revisit the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, payload, payload_digest, refers_to, revisit`` rows to archives in ``folder``; the rows returned are the index.

    A task names its files anew on each attempt, so what a lost or repeated attempt wrote is in no index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    body = gzip.compress(record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], row["revisit"]), LEVEL, mtime=0)
                    out.write(body)
                    rows.append((name, at, len(body), row["url"], row["page_id"], row["payload_digest"], "revisit" if row["revisit"] else "response"))
                    at += len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return pages.mapInArrow(write, _INDEX_DDL)


def byte_ranges(entries: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """(first entry, after the last, offset, length) of the reads that cover sorted (offset, length) entries."""
    out, first = [], 0
    for i in range(1, len(entries) + 1):
        if i == len(entries) or entries[i][0] - sum(entries[i - 1]) > gap or sum(entries[i]) - entries[first][0] > most:
            out.append((first, i, entries[first][0], sum(entries[i - 1]) - entries[first][0]))
            first = i
    return out


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` selects. Rows of one stretch of a file meet in one task, sorted, and are fetched by few reads.

    ``payload_bytes`` and ``payload_digest`` describe the full payload, also for revisits, whose own payload is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            files, entries = batch.column("file").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            lo = 0
            for hi in range(1, len(files) + 1):
                if hi < len(files) and files[hi] == files[lo]:
                    continue
                with store.open_input_file(f"{root}/{files[lo]}") as source:
                    for first, last, offset, length in byte_ranges(entries[lo:hi]):
                        data = source.read_at(length, offset)
                        yield records(data, offset, entries[lo + first : lo + last])
                lo = hi

    def records(data: bytes, offset: int, entries: list[tuple[int, int]]) -> pa.RecordBatch:
        rows = []
        for at, length in entries:
            warc, http, payload = parse(gzip.decompress(data[at - offset : at - offset + length]))
            revisit, digest = warc["warc-type"] == "revisit", warc["warc-payload-digest"].removeprefix("sha256:")
            if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"record {warc['warc-record-id']} is damaged")
            rows.append((_page(warc["warc-record-id"]), warc.get("warc-target-uri"), int(http["content-length"]), digest, warc["warc-type"], _page(warc.get("warc-refers-to")), payload if payloads and not revisit else None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _RECORD_DDL.split(", ")])

    entries = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN_BYTES).alias("span"))
    # a number of its own: the index is small, what it points at is not
    tasks = partitions_for(index, index.agg(F.sum("length")).first()[0] or 0, SPAN_BYTES)
    entries = entries.repartition(tasks, "file", "span").sortWithinPartitions("file", "offset")
    return entries.select("file", "offset", "length").mapInArrow(read, _RECORD_DDL)


def with_revisits(pages: DataFrame, work: Workspace, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to, revisit`` of each page.

    Of pages with one payload of ``least`` bytes or more the smallest ``page_id`` is the response. Only ids and digests are
    shuffled to find it; the payloads stay where they are when the list of revisits is small enough to send around.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    slim = work.keep(rows.select("page_id", "payload_digest", F.octet_length("payload").alias("bytes")), "digests").filter(F.col("bytes") >= least)
    firsts = slim.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    others = slim.join(firsts, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    others = others.groupBy("page_id", "payload_digest").agg(F.first("refers_to").alias("refers_to"))
    others = work.keep(others.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to"), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d"))
    return rows.join(others, same, "left").select("page_id", "url", "payload", "payload_digest", "refers_to", F.col("d").isNotNull().alias("revisit"))


def archive_and_read(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write every page to archives and read them back through the index; one row per row of ``pages``.

    A null html is an empty payload, a null url is left out of the record, control characters of a url are
    percent-encoded. A page without id is a revisit when a page with an id has its payload; rows that repeat the smallest id
    of a payload are responses all. No pages give no rows. Columns other than ``page_id``, ``url``, ``html`` are not read.
    """
    work = Workspace(pages.sparkSession, "warc")
    index = work.keep(write_archives(with_revisits(pages, work), work.path("archives")), "index")
    return read_archives(index, work.path("archives"), payloads)
