"""Windows, running values, packing and top-k against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casefile_spark.functions import folds, text, topk, vectors
from casefile_spark.functions.segments import Running, block_of, islands, running, segmented

FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def brute_windows(tokens, size=700, overlap=100):
    out, start = [], 0
    while start < len(tokens):
        end = min(start + size, len(tokens))
        out.append(" ".join(tokens[start:end]))
        if end == len(tokens):
            break
        start = end - overlap
    return out


def test_windows_cover_and_overlap(spark):
    sizes = [0, 1, 99, 100, 101, 699, 700, 701, 1299, 1300, 1301, 5000]
    rows = [(n, " ".join(f"t{i}" for i in range(n))) for n in sizes]
    df = spark.createDataFrame(rows, "n int, text string").select("n", text.token_windows(text.tokens(F.col("text"))).alias("w"))
    for r in df.collect():
        assert r.w == brute_windows([f"t{i}" for i in range(r.n)])


@FEW
@given(st.lists(st.lists(st.integers(0, 160), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(1, 20), st.sampled_from([0, 7]))
def test_next_fit_equals_the_loop(spark, groups, segment_rows, reset):
    rows, want = [], {}
    for key, sizes in enumerate(groups):
        total, batch = 0, 0
        for i, s in enumerate(sizes):
            if i and total + s > 100:
                batch, total = batch + 1, reset
            total += s
            want[key, i] = batch
            rows.append((key, i, s))
    df = spark.createDataFrame(rows, "key int, pos int, size int")
    got = folds.next_fit(df, ["key"], "pos", "size", 100, reset=F.lit(reset), segment_rows=segment_rows)
    assert {(r.key, r.pos): r.batch_no for r in got.collect()} == want


def test_next_fit_one_hot_key(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 30, 60, 120]) for _ in range(3000)]
    df = spark.createDataFrame([("hot", i, s) for i, s in enumerate(sizes)] + [("cold", 0, 5)], "key string, pos int, size int")
    got = {r.pos: r.batch_no for r in folds.next_fit(df, ["key"], "pos", "size", 100, segment_rows=64).collect() if r.key == "hot"}
    total, batch = 0, 0
    for i, s in enumerate(sizes):
        if i and total + s > 100:
            batch, total = batch + 1, 0
        total += s
        assert got[i] == batch


@pytest.mark.parametrize("rows_per_segment", [1, 4, 1000])
def test_running_values(spark, rows_per_segment):
    rng = random.Random(5)
    data = [(k, i, rng.choice([None, 1, 2, 3])) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(data, "k string, t int, n int")
    out = running(
        df, ["k"], ["t"], block_of(F.col("t"), rows_per_segment), Running("sum", F.coalesce("n", F.lit(0)), "s"), Running("min", F.col("n"), "lo"),
        Running("max", F.col("n"), "hi"), Running("last", F.col("n"), "last"), Running("previous", F.col("n"), "prev"),
    )
    state = {}
    for r in out.orderBy("k", "t").collect():
        s = state.setdefault(r.k, {"s": 0, "seen": [], "prev": None})
        assert r.prev == s["prev"]
        s["prev"] = r.n
        if r.n is not None:
            s["s"] += r.n
            s["seen"].append(r.n)
        assert r.s == s["s"]
        assert (r.lo, r.hi, r["last"]) == ((min(s["seen"]), max(s["seen"]), s["seen"][-1]) if s["seen"] else (None, None, None))


@pytest.mark.parametrize("rows_per_segment", [1, 3, 1000])
def test_islands(spark, rows_per_segment):
    rng = random.Random(7)
    data = [(k, i, rng.choice(["x", "y", None])) for k in "abc" for i in range(40)]
    df = spark.createDataFrame(data, "k string, t int, v string")
    seen = {}
    for r in islands(df, ["k"], ["t"], block_of(F.col("t"), rows_per_segment), ["v"], "run").orderBy("k", "t").collect():
        last, n = seen.get(r.k, (object(), 0))
        n += last != r.v
        assert r.run == n
        seen[r.k] = (r.v, n)


def test_rows_are_shuffled_once_for_several_running_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    df = segmented(df, ["k"], block_of(F.col("t"), 100))
    df = running(df, ["k"], ["t"], None, Running("sum", F.lit(1), "n"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("REPARTITION_BY_COL") >= 2


@FEW
@given(st.integers(1, 12), st.booleans(), st.sampled_from([2, 1000]))
def test_top_k_is_exact_with_ties(spark, k, per_collection, max_queries):
    rng = np.random.default_rng(k)
    vec = rng.normal(size=(120, 6)).astype(np.float32)
    vec[20:60] = vec[0]  # a third of the table are copies
    vec[7] = 0
    chunks = spark.createDataFrame(
        [(f"c{i % 3}", i % 3, i, str(i), vec[i].tolist()) for i in range(120)],
        "collection string, collection_pos int, chunk_no int, chunk_key string, embedding array<float>",
    )
    queries = spark.createDataFrame([(j, k + j, vec[j * 9].tolist()) for j in range(4)], "query_id long, k int, embedding array<float>")
    got = topk.cosine_top_k(chunks, queries, per_collection, max_queries=max_queries, rows_per_block=30)
    unit = vec.astype(float)
    n = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(n == 0, 1, n)
    want = set()
    for j in range(4):
        score = np.round(unit @ unit[j * 9], 12)
        groups = [[i for i in range(120) if i % 3 == c] for c in range(3)] if per_collection else [range(120)]
        for g in groups:
            best = sorted(g, key=lambda i: (-score[i], i % 3, i))[: k + j]
            want |= {(j, pos + 1, str(i)) for pos, i in enumerate(best)}
    assert {(r.query_id, r.rank, r.chunk_key) for r in got.collect()} == want


def test_top_k_of_merged_top_k(spark):
    """Per-collection top-k followed by a global top-k loses nothing."""
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame(
        [(f"c{i % 5}", i % 5, i, str(i), rng.normal(size=4).tolist()) for i in range(200)],
        "collection string, collection_pos int, chunk_no int, chunk_key string, embedding array<float>",
    )
    queries = spark.createDataFrame([(0, 6, [1.0, 0.5, 0.0, 0.2])], "query_id long, k int, embedding array<double>")
    keep = topk.cosine_top_k(chunks, queries, per_collection=True).select("chunk_key")
    direct = topk.cosine_top_k(chunks, queries).orderBy("rank").select("chunk_key").collect()
    staged = topk.cosine_top_k(chunks.join(keep, "chunk_key", "left_semi"), queries).orderBy("rank").select("chunk_key").collect()
    assert direct == staged


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r.u for r in df.select(vectors.l2_normalise(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_entities_and_tags(spark):
    html = "<p>Fish &amp; chips &lt;now&gt; &#8217;x&#x41; &nosuch; &amp;quot;</p><!-- gone --><br>a  \n\n\n\nb"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.html_to_text(F.col("h"))).first()[0] == "Fish & chips <now> ’xA &nosuch; &quot;a\n\nb"


def test_legible_ratio(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("ab──",), ("é",)], "t string")
    assert [r[0] for r in df.select(text.legible_ratio(F.col("t"))).collect()] == [1.0, 1.0, 0.5, 0.0]


def test_a_batch_of_vectors_is_scored_in_slices(spark, monkeypatch):
    """Only so many vectors of a batch are copied and scored at once, with the same hits."""
    from casefile_spark.functions import topk

    at = F.col("id")
    chunks = spark.range(0, 100, 1, 1).select(F.lit("c").alias("collection"), F.lit(0).alias("collection_pos"), at.alias("chunk_no"), at.cast("string").alias("chunk_key"), F.array(F.cos(at / 7), F.sin(at / 7)).alias("embedding"))
    queries = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, 3, [0.3, 0.7])], "query_id long, k int, embedding array<double>")
    want = sorted(map(tuple, topk.cosine_top_k(chunks, queries).collect()))
    whole, sizes = topk._score_table, spark.sparkContext.accumulator(0)

    def counted(table, *rest):
        sizes.add(table.num_rows > 16)
        return whole(table, *rest)

    monkeypatch.setattr(topk, "SCORE_ROWS", 16)
    monkeypatch.setattr(topk, "_score_table", counted)
    assert sorted(map(tuple, topk.cosine_top_k(chunks, queries).collect())) == want and len(want) == 8 and sizes.value == 0


def test_short_keys_cross_arrow_batches(spark):
    rng = random.Random(12)
    rows = [(None if k == 0 else f"k{k}", i, rng.choice([0, 1, 30, 60, 120])) for k in range(40) for i in range(rng.choice([1, 3, 70]))]
    df = spark.createDataFrame(rows, "key string, pos int, size int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r.key, r.pos): (r.batch_no, r.size_) for r in folds.pack_short(df.withColumn("size_", F.col("size")), ["key"], "pos", "size", 100, ["size_"], initial=F.lit(5), reset=F.lit(50)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows)
    total, batch = 0, 0
    for key, i, s in rows:
        if i == 0:
            total, batch = 5, 0
        elif total + s > 100:
            total, batch = 50, batch + 1
        total += s
        assert got[key, i] == (batch, s)
