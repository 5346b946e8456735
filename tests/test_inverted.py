"""The positional index and its search against a plain scan: phrases, ties, repeated and null documents, bounds that skip blocks."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casefile_spark.functions import inverted
from casefile_spark.operators import shortlist as S


def terms(text):
    return [t for t in re.split(r"[^\w']+", (text or "").lower()) if t]


def plain(docs, queries, page):
    n, tokens = len(docs), [terms(t) for _, t in docs]
    out = []
    for q, text in queries:
        asked, phrases = set(terms(text.replace('"', " "))), [p for p in map(terms, re.findall(r'"([^"]+)"', text)) if p]
        df = {t: sum(t in words for words in tokens) for t in asked}
        scores = []
        for (i, _), words in zip(docs, tokens):
            score = sum(words.count(t) * math.log((n + 1) / df[t]) for t in asked if t in words)
            if score > 0:
                held = any(words[k : k + len(p)] == p for p in phrases for k in range(len(words)))
                scores.append((-round(score * (2 if held else 1), 9), i))
        out += [(q, i, place, -s) for place, (s, i) in enumerate(sorted(scores)[:page])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["of", "the"] * 20
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 200])))) for i in range(900)]
    docs += [(i, docs[i % 7][1]) for i in range(900, 1000)] + [(1001, None), (1002, ""), (1003, "Of, THE w1!")]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    queries += [(100, '"of the" w1'), (101, '"w1 w2" "of the w3" w4'), (102, '"..." w5'), (103, "absent"), (104, ""), (105, '"the of the"')]
    return docs, queries


@pytest.mark.parametrize("page", [5, 100])
def test_search_equals_a_plain_scan(spark, corpus, page, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(inverted, "SLICE_QUERIES", 10)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    got = S.search_corpus(d, q, page).select("query_id", "doc_id", "position", "score").collect()
    want = plain(docs, queries, page)
    assert sorted(tuple(r)[:3] for r in got) == [w[:3] for w in want]
    assert [r.score for r in sorted(got)] == pytest.approx([w[3] for w in want], abs=1e-6)


def test_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b b"), (None, "b")], "doc_id long, text string")
    q = spark.createDataFrame([("x", "b")], "query_id string, query string")
    assert sorted((r.doc_id or -1, r.position) for r in S.search_corpus(d, q).collect()) == [(-1, 1), (1, 0), (1, 2)]
    assert S.search_corpus(d.limit(0), q).collect() == []
    assert S.search_corpus(d, q.limit(0)).collect() == []


def test_a_saved_index_answers_other_queries(spark, corpus, tmp_path):
    docs, queries = corpus
    S.search_index(spark.createDataFrame(docs, "doc_id long, text string")).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for some in (queries[:3], queries[-6:]):
        got = S.search(index, spark.createDataFrame(some, "query_id long, query string"), 10).collect()
        assert sorted((r.query_id, r.doc_id, r.position) for r in got) == [w[:3] for w in plain(docs, some, 10)]


def test_bounds_leave_out_blocks(spark):
    """Long documents come first, so blocks of short ones cannot reach the first page."""
    docs = [(i, "a " * (50 if i % 100 == 0 else 1) + f"x{i}") for i in range(20_000)]
    index = inverted.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).select("doc_id", F.split("text", " ").alias("w")), "doc_id", "w")
    postings = pa.Table.from_batches(index.filter(F.col("term").isin("a", inverted.ALL)).toArrow().to_batches())
    queries = pa.table({"query_id": [1], "terms": [["a"]], "weights": [[0.5]], "phrases": pa.array([[]], pa.list_(pa.list_(pa.string())))})
    best, keys, _, pairs, scored = inverted.best_of_part(postings, queries, 100)
    assert sorted(keys.take(pa.array(best[0][1])).to_pylist())[:100] == [i for i in range(20_000) if i % 100 == 0][:100]
    assert pairs == 79 and scored == 1


def test_a_batch_of_long_texts_is_cut_into_parts(spark, monkeypatch):
    """A task indexes about PART_WORDS words at once, however many words its batches hold."""
    monkeypatch.setattr(inverted, "PART_WORDS", 50)
    docs = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.col("id") % 13), lambda x: F.concat(F.lit("w"), x.cast("string"))).alias("words"))
    index = inverted.build_index(docs, "id", "words").cache()
    words = index.filter(F.col("term") != inverted.ALL).groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0), lambda a, b: a + b)).alias("n"))
    assert words.count() > 4 and words.agg(F.max("n")).first()[0] <= 50
    assert sorted(r[0] for r in index.filter(F.col("term") == inverted.ALL).select(F.explode("docs")).collect()) == [*range(40)]
    index.unpersist()
