"""Secret scans by novelty under zstandard, beside three fixed patterns.

A candidate stands near a word that speaks of credentials. What it costs is measured: the bytes by which the compressed
surroundings grow when the candidate is put in, with a dictionary of the identifiers that stand in such places all over
the corpus. Names and words are cheap there; a string that costs nearly as much as random characters is reported.
Frequency makes no identifier: what is novel beside the fixed words of ``BASE`` stays out of the dictionary in whole, and a
text counts once however many copies it has.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "novel")

CONTEXT = ("passw", "secret", "token", "key", "auth", "cred", "bearer", "private")
CONTEXT_WORD = re.compile("|".join(CONTEXT), re.A | re.I)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
INSIDE = re.compile(r"[A-Za-z0-9+/_=-]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{4,39}")
REACH = 64
AROUND = 512
NOVELTY = 0.7
DICTIONARY_BYTES = 32 << 10
DICTIONARY_NAMES = 4_000

BASE = b"""abstract access account action active adapter address admin agent algorithm alert alias allow amount analysis android api app
application archive argument array artifact async attribute audit auth authentication authorization author auto available backend
background backup base batch bearer binary block body boolean bucket buffer build builder bundle button byte cache callback
cancel capacity card catalog category certificate chain change channel character check checksum child class cleanup client clock cloud cluster
code collection column command comment commit common component compress config configuration connect connection console constant
container content context control controller cookie copy core count create creation credential credentials current custom customer data
database date debug decode decrypt default definition delete deploy deployment description destination detail development device
dictionary digest directory disable disk dispatch display document domain download driver dynamic element email enable encode encrypt encryption
endpoint engine entity entry environment error event example exception execute execution expire expiration export expression
extension external factory failure feature field file filter find first flag folder format forward frame function gateway generate generator
global graph group handle handler hash header health hidden history hook host http https identifier identity image import
index info information init initial input insert instance integer integration interface internal interval invalid item iterator job
json key keyboard label language last layer layout length level library license limit line link list listener load local location lock log
logger login logout machine main manage manager management manifest map master match maximum memory merge message metadata method
metric middleware minimum mobile mode model module monitor name namespace native network next node notification null number object offset
online open operation operator option order organization origin output owner package page parameter parent parse parser partition
password path pattern payload payment performance permission persistent phone pipeline platform plugin policy pool port position
prefix previous primary printer priority private process processor product production profile program project property protocol
provider proxy public publish query queue random range rate read record redirect reference refresh region register registry release remote
remove render replace report repository request require reset resource response result return role root route router rule runtime
sample save scan schedule scheduler schema scope script search secret section secure security select sender sequence serial serialize
server service session setting settings setup shadow share shared signature signing simple single size socket sort source
space special stage standard start state static statistics status step stop storage store stream string structure style submit subscription
suffix summary support switch sync system table tag target task template temporary tenant test text thread threshold time timeout
timestamp title token total trace tracking transaction transfer transform transport trigger type unique unit update upgrade upload url user
username utility valid validate validation value variable vault vendor verify verification version view virtual visible volume wait
warning watch web webhook weight width window worker workflow workspace wrapper write writer zone"""

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """The fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped; by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    at = 0
    while m := LONG_HEX.search(text, at):  # a run of 24 is found first, then taken to its ends
        start = m.start()
        at = HEX.match(text, start).end()
        out.append((start, 2, at))
    return sorted(out)


def _near(text: str) -> list[tuple[int, int]]:
    """Stretches that follow a context word, merged."""
    out: list[tuple[int, int]] = []
    for m in CONTEXT_WORD.finditer(text):
        lo, hi = m.start(), m.end() + REACH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _has_context(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in CONTEXT)


def marginal_bytes(compressor: zstandard.ZstdCompressor, before: str, candidate: str, after: str) -> int:
    """What the candidate adds to its compressed surroundings."""
    return len(compressor.compress((before + candidate + after).encode())) - len(compressor.compress((before + after).encode()))


def novel_spans(text: str, taken: list[Span], compressor: zstandard.ZstdCompressor) -> list[Span]:
    """Candidates whose marginal bytes reach ``NOVELTY`` of their length; what a fixed pattern covers is left to it."""
    out = []
    for lo, hi in _near(text):
        at = lo
        while (m := CANDIDATE.search(text, at)) and m.start() < hi:
            at = m.end()
            if any(m.start() < end and start < m.end() for start, _, end in taken):
                continue
            cost = marginal_bytes(compressor, text[max(0, m.start() - AROUND) : m.start()], m[0], text[m.end() : m.end() + AROUND])
            if cost >= NOVELTY * len(m[0]) and (m.start(), 3, m.end()) not in out:
                out.append((m.start(), 3, m.end()))
    return out


def base_compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(BASE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=words, write_content_size=False, write_checksum=False)


def names_of(text: str, base: zstandard.ZstdCompressor) -> set[str]:
    """Identifiers around the text's context words, without candidates that are novel beside ``BASE``, nor any part of these."""
    out: set[str] = set()
    for lo, hi in _near(text):
        lo = max(0, lo - REACH)
        while lo and INSIDE.match(text[lo - 1]):  # strings are taken whole
            lo -= 1
        hi = INSIDE.match(text, hi).end() if hi < len(text) and INSIDE.match(text, hi) else hi
        known = CANDIDATE.sub(lambda m: m[0] if marginal_bytes(base, "", m[0], "") < NOVELTY * len(m[0]) else " ", text[lo:hi])
        out.update(IDENTIFIER.findall(known))
    return out


def identifiers(docs: DataFrame) -> DataFrame:
    """``name``, ``n``: identifiers that stand around context words, and in how many different texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = base_compressor()
        for batch in batches:
            texts = {t for t in batch.column("text").to_pylist() if t and _has_context(t)}
            rows = [(xxhash.xxh3_128_digest(t.encode()), list(names)) for t in texts if (names := names_of(t, base))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["digest", "names"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    different = rows.mapInArrow(count, "digest binary, names array<string>").groupBy("digest").agg(F.first("names").alias("names"))
    return different.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def dictionary(docs: DataFrame) -> bytes:
    """The most frequent identifiers, as many as fit ``DICTIONARY_BYTES``, the most frequent last; names of one text are no identifiers."""
    top = identifiers(docs).filter("n > 1").orderBy(F.col("n").desc(), "name").limit(DICTIONARY_NAMES).collect()
    out, size = [], 0
    for row in top:
        size += len(row["name"]) + 1
        if size > DICTIONARY_BYTES:
            break
        out.append(row["name"].encode())
    return b" ".join(reversed(out))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts per kind, ``base_sha256`` of the fixed patterns' spans, ``spans`` of all.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas. A null text is empty,
    and an empty text has no spans. Texts are read whole. Columns other than ``doc_id`` and ``text`` are not read.
    """
    primer = dictionary(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
        compressor = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                novel = novel_spans(text, base, compressor) if _has_context(text) else []
                n = Counter(kind for _, kind, _ in base)
                rows.append((n[0], n[1], n[2], len(novel), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + novel))))
            if rows:
                kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[c.split()[0] for c in _RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _RESULT)
