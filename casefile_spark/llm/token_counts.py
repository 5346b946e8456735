"""Token counts from an exact histogram of encoded lengths.

Every text is encoded once, whole; documents are added up by their length. The histogram has a row per length that
occurs, however many documents there are, and running sums over it from the long end answer totals, quantiles and
the tokens left when every document is cut at any context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[tuple[str, int], tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a rank file's lines, made once per worker."""
    key = (pattern, hash(ranks))
    if key not in _ENCODERS:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each whole text; strings of special tokens are ordinary text, null is empty.

    The vocabulary is one file of a bounded size, read by the driver and sent to the workers.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is over {MAX_VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text.as_py())) if text.is_valid else 0 for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``length``, ``n_docs`` and sums from the long end: for the context limit ``length``, how many documents are longer,
    how many tokens they hold, and how many tokens all documents hold when cut at the limit; ``share_at_most`` is the quantile.

    No documents give no rows. The window is over lengths that occur, not documents.
    """
    rows = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    tokens = F.col("length") * F.col("n_docs")
    rows = rows.withColumns({
        "longer_docs": F.coalesce(F.sum("n_docs").over(longer), F.lit(0)),
        "longer_tokens": F.coalesce(F.sum(tokens).over(longer), F.lit(0)),
        "total_docs": F.sum("n_docs").over(whole),
        "total_tokens": F.sum(tokens).over(whole),
    })
    return rows.withColumns({
        "truncated_tokens": F.col("total_tokens") - F.col("longer_tokens") + F.col("longer_docs") * F.col("length"),
        "share_at_most": 1.0 - F.col("longer_docs") / F.col("total_docs"),
    })


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens that all documents hold when cut at each of ``limits``, from the histogram alone."""
    sums = [F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("length"), F.lit(n).cast("long"))), F.lit(0)).alias(f"at_{n}") for n in limits]
    return histogram.agg(*sums)


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents don't exceed; null without documents."""
    return histogram.filter(F.col("share_at_most") >= share).agg(F.min("length").alias("length"))
