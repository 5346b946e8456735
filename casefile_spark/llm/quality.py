"""Quality classifier by co-training.

Two classifiers see a document from two sides: what its text is made of, and its metadata (source, language, length). Each is
fitted on the labelled rows; then, for some rounds, each labels documents of an unlabelled pool and hands those it is
confident of to the other. Held-out labels calibrate both, and the calibrated views together score every document.

Fitting takes a bounded sample, ``LABELLED`` labelled and ``POOL`` unlabelled documents at most in expectation, drawn by a hash of the
id; scoring runs over all documents in whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace
from .words import chunks, find_words

LABELLED = 20_000
POOL = 20_000
ROUNDS = 3
CONFIDENT = 0.98
EXCHANGED = 2_000
HELD_OUT = 5
THRESHOLD = 0.5
BUCKETS, SOURCES, LANGS = 64, 64, 16

_ALNUM = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = np.zeros((256, 6 + len(_PUNCTUATION)))
for _i, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 32), (10, 13), range(128, 256), *([c] for c in _PUNCTUATION))):
    _CLASSES[list(_bytes), _i] = 1.0


def content_view(texts: pa.Array) -> np.ndarray:
    """A row of features per text: shares of character classes and of each punctuation mark, shapes of words, hashed words."""
    words = find_words(texts)
    n, lengths = len(texts), pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, byte_row = words.row(), np.repeat(np.arange(n), lengths)
    counts = np.bincount(byte_row * 256 + words.data, minlength=n * 256).reshape(n, 256) @ _CLASSES
    codes, size = words.codes(), (words.stop - words.start).astype(np.float64)
    per_word = np.maximum(np.diff(words.first), 1).astype(np.float64)
    head, tail = words.data[words.start], words.data[words.stop - 1]
    upper = (head >= 65) & (head <= 90)
    marked = (tail < 128) & ~_ALNUM[tail]
    distinct = np.zeros(n)
    order = np.lexsort((codes, row))
    if order.size:
        new = np.concatenate([[True], (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1])])
        distinct = np.bincount(row[order][new], minlength=n).astype(np.float64)
    shapes = [np.bincount(row, x, n) / per_word for x in (size, size * size / 10, (size >= 5).astype(float), (size == 1).astype(float), upper.astype(float), marked.astype(float))]
    hashed = np.bincount(row * BUCKETS + (codes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) / per_word[:, None]
    return np.column_stack([counts / np.maximum(lengths, 1)[:, None], *shapes, distinct / per_word, np.log1p(np.diff(words.first)), hashed])


def metadata_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """A row of features per document: hashed source and language, and the length on a log scale; nulls are values of their own."""
    out = np.zeros((len(source), SOURCES + LANGS + 3))
    for names, at, width in ((source, 0, SOURCES), (lang, SOURCES, LANGS)):
        out[np.arange(len(names)), at + np.array([xxhash.xxh3_64_intdigest(str(x)) % width for x in names.to_pylist()], dtype=np.int64)] = 1.0
    size = np.log1p(np.maximum(n_chars.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), 0))
    out[:, -3:] = np.column_stack([size, size * size / 10, np.array([not v.is_valid for v in n_chars], dtype=float)])
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """A logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 5.0, steps: int = 12) -> Model:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
        for _ in range(steps):  # Newton's method
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]


@dataclass
class CoTrained:
    models: list[Model]
    slopes: list[tuple[float, float]]
    prior: float

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views, and of both together: their evidence beyond the prior adds up."""
        logits = [a * m.margin(x) + b for m, (a, b), x in zip(self.models, self.slopes, views)]
        return (*(_sigmoid(z) for z in logits), _sigmoid(logits[0] + logits[1] - self.prior))


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scaling with his smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    m = Model.fit(margin[:, None], target, ridge=1e-3, steps=30)
    a = m.weights[0] / m.scale[0]
    return float(max(a, 0.0)), float(m.weights[1] - a * m.mean[0] if a > 0 else np.log(good + 1) - np.log(bad + 1))


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> CoTrained | None:
    """``y`` is 1, 0 or NaN (unlabelled); ``held`` marks labelled rows kept for calibration. None when a class is missing."""
    labelled, pool = ~np.isnan(y) & ~held, np.flatnonzero(np.isnan(y))
    if len({*y[labelled]}) < 2 or len({*y[held]}) < 2:
        return None
    given = [np.full(len(y), np.nan) for _ in views]
    models: list[Model] = []
    for step in range(rounds + 1):
        models = []
        for x, extra in zip(views, given):
            rows = labelled | ~np.isnan(extra)
            models.append(Model.fit(x[rows], np.where(labelled, y, extra)[rows]))
        if step == rounds or not pool.size:
            break
        for a, b in ((0, 1), (1, 0)):
            p = _sigmoid(models[a].margin(views[a][pool]))
            fresh = np.isnan(given[b][pool])
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(fresh & (sure >= CONFIDENT))
                best = best[np.argsort(-sure[best], kind="stable")][: int(EXCHANGED * (y[labelled] == value).mean()) + 1]
                given[b][pool[best]] = value
    good = float(y[labelled].mean())
    return CoTrained(models, [_calibrated(m.margin(x[held]), y[held]) for m, x in zip(models, views)], float(np.log(good / (1 - good))))


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [content_view(batch.column("text")), metadata_view(batch.column("source"), batch.column("lang"), batch.column("n_chars"))]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        rows = [pa.array(list(v), pa.list_(pa.float64())) for v in _views(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *rows], names=["doc_id", "quality", "content", "metadata"])


def _drawn(doc_id: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """The co-trained model, from a bounded sample; None when the labels lack a class."""
    work = Workspace(docs.sparkSession, "quality")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(F.max((F.col("quality") > 0).cast("double")).alias("quality"))
    known = work.keep(known, "labels")
    n_known, n_docs = known.count(), docs.count()
    if not n_known:
        return None
    rows = _prepared(docs).filter("doc_id is not null")
    drawn = known.filter(_drawn(F.col("l"), LABELLED / n_known))
    share = POOL / max(1, n_docs - n_known)
    sampled = rows.join(drawn, F.col("doc_id") == F.col("l")).drop("l")
    pool = rows.filter(_drawn(F.col("doc_id"), share)).join(known.select("l"), F.col("doc_id") == F.col("l"), "left_anti").withColumn("quality", F.lit(None).cast("double"))
    features = sampled.unionByName(pool).mapInArrow(_features, "doc_id long, quality double, content array<double>, metadata array<double>")
    table = work.keep(features, "features").toArrow().sort_by("doc_id")
    if not table.num_rows:
        return None
    views = [np.array(table[c].combine_chunks().flatten()).reshape(table.num_rows, -1) for c in ("content", "metadata")]
    y = table["quality"].to_numpy().astype(np.float64)
    held = ~np.isnan(y) & (np.array([xxhash.xxh3_64_intdigest(str(i)) % HELD_OUT for i in table["doc_id"].to_pylist()]) == 0)
    return co_train(views, y, held, rounds)


def _prepared(docs: DataFrame) -> DataFrame:
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``content_quality``, ``metadata_quality``, ``quality`` (probabilities), ``keep``.

    ``docs`` has ``doc_id, text, source, lang, n_chars``, ``labels`` has ``doc_id, quality``; more columns are not read. A label above 0 is
    good; labels without id or value are left out, and of several labels of one id the best counts. Nulls are values of
    their own in the metadata, null text is empty. If the labels lack a class, quality is 1 and all documents are kept.
    """
    model = fit(docs, labels, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            one = np.ones(batch.num_rows)
            p = model.scores(_views(batch)) if model else (one, one, one)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= THRESHOLD)], names=["doc_id", "content_quality", "metadata_quality", "quality", "keep"])

    return _prepared(docs).mapInArrow(score, "doc_id long, content_quality double, metadata_quality double, quality double, keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, in one pass without a shuffle."""
    model = fit(docs, labels, rounds)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(model.scores(_views(batch))[2] >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema) if model else docs
