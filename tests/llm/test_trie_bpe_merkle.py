"""Prefix trie, BPE and Merkle manifest against plain versions, on nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casefile_spark.llm import bpe, merkle, prefix_trie, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- prefix trie ------------------------------------------------------------------------------------------------------


def plain_trie(rows, shared):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    said = {c: [row[2:] for row in sorted(v)] for c, v in convs.items()}
    if shared:
        group, heads = shared
        head = {c: zlib.crc32(str(c).encode()) % heads for c in said}
        said = {c: said.get(c - c % group, [])[: head[c]] + v[head[c] :] for c, v in said.items()}
    members, below, totals, out = {}, {}, {}, []
    for c, v in said.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            below.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        children, n = below.get(k, []), len(members[k])
        leaves = sum(totals[x][0] for x in children) or 1
        saved = (n - 1) * (len(k[-1][1]) if k else 0) + sum(totals[x][1] for x in children)
        totals[k] = (leaves, saved)
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(said[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(children), leaves, saved, sha(ends)))
    return sorted(out, key=str)


def spark_trie(spark, rows, shared):
    schema = "conv_id long, turn long, role string, text string, node string, path string, items int, low long"
    df = spark.createDataFrame([(*r, "n", "p", 1, 2) for r in rows], schema)
    return sorted((tuple(r)[:8] for r in prefix_trie.prefix_trie(df, shared).collect()), key=str)


def said(conv, n, change=None):
    return [(conv, i, "user", "q" if i == change else f"t{i % 3}") for i in range(n)]


@pytest.mark.parametrize("shared", [None, (100, 6)])
def test_trie_of_random_turns_with_nulls_ties_and_repeats(spark, shared):
    rng = random.Random(3)
    rows = [(rng.randrange(260), rng.choice([None, *range(9)]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "yé", "zz"])) for _ in range(1500)]
    rows += rows[:40] + [(None, 1, "u", "x"), (5, 3, "u", "z" * 100_000), (6, 3, "u", "z" * 100_000)]
    assert spark_trie(spark, rows, shared) == plain_trie(rows, shared)


def test_trie_of_long_conversations_crosses_bands(spark):
    rows = [*said(7, 500), *said(107, 400), *said(207, 330, 300), *said(300, 256), *said(301, 127), *said(302, 128), *said(303, 3)]
    assert spark_trie(spark, rows, (100, 6)) == plain_trie(rows, (100, 6))


def test_trie_of_copies_that_span_shards(spark):
    """Copies of one conversation among all shards; their ids come in several blocks."""
    rows = [(c, t, "user", "same") for c in range(3000) for t in range(3)] + [(c, t, "user", f"{c % 7}") for c in range(3000, 3400) for t in range(c % 5)]
    assert spark_trie(spark, rows, None) == plain_trie(rows, None)
    assert spark_trie(spark, [(c, 0, None, None) for c in range(10_000)], None) == plain_trie([(c, 0, None, None) for c in range(10_000)], None)


def test_trie_without_conversations(spark):
    assert spark_trie(spark, [], (100, 6)) == []
    assert spark_trie(spark, [(None, 0, "u", "x")], None) == []


def test_spilling_queue_gives_messages_in_order_and_merges():
    rng = random.Random(5)
    sums, plain = prefix_trie.SpillingQueue(lambda a, b: a + b, limit=10), prefix_trie.SpillingQueue(limit=10)
    want = {}
    for i in range(500):
        key, value = rng.randrange(60), rng.randrange(100)
        want.setdefault(key, []).append(value)
        sums.push(key, value)
        plain.push(key, value)
    assert len(sums.runs) > 3 and len(plain.runs) > 30
    for key in range(0, 60, 2):  # odd keys are passed over
        assert sum(sums.take(key)) == sum(want.get(key, []))
        assert sorted(plain.take(key)) == sorted(want.get(key, []))
    assert [*sums.take()] == want.get(59, []) or sum(sums.take()) == 0


# -- BPE --------------------------------------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "Hello  world\n\n it's we'll 123 x1é", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endo", "x" * 3000, " " * 200 + "a", "ünïcödé 日本語 🙂🙂​ z",
    "\x00\x1c\x85᠎", "aaaa" * 50, "ab" * 5000,
]


def reference(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_against_the_library(spark):
    rng = random.Random(11)
    letters = "abc déß\n\t'1234.,日🙂 tshreino"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)] + TEXTS[:6]
    docs = spark.createDataFrame([(i // 2, t, "k", "i") for i, t in enumerate(texts)], "doc_id long, text string, key string, ids string")
    found = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    ids, decoded = reference(texts)
    want = sorted((i // 2, tuple(a), b) for i, (a, b) in enumerate(zip(ids, decoded)))
    assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text) for r in found) == want


def test_bpe_of_every_character_matches_the_library():
    own, library = bpe.Bpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = [f"a{c}b{c}{c} {c}1{c}  x " for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)])]
    for ids, e in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_bpe_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids, decoded = reference(TEXTS)
    want = [(i, len(a), hashlib.sha256(np.array(a, "<u4").tobytes()).hexdigest(), sha(b)) for i, (a, b) in enumerate(zip(ids, decoded))]
    assert sorted(tuple(r) for r in queries.op12_bpe(spark, str(tmp_path)).collect()) == want
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_bpe_pieces_of_all_lengths_side_by_side_and_alone(monkeypatch):
    rng = random.Random(9)
    own, library = bpe.Bpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    pieces = ["".join(rng.choice("aabet hin") for _ in range(n)).replace(" ", "s") for n in [*range(1, 70), 300, 1000] * 8]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 200)  # begins anew within the texts
    for some in (pieces[:200], pieces[200:], pieces[::-1]):
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert len(own.known) <= 1 + len(set(some))
    assert all(own.encode_piece(p) == own.encode([p])[0] for p in pieces)


def test_pair_tree_yields_leftmost_lowest():
    rng = random.Random(2)
    for n in (1, 2, 5, 33):
        ranks = [rng.choice([bpe.NONE, 1, 2, 3]) for _ in range(n)]
        tree = bpe.PairTree(ranks)
        for _ in range(60):
            low = min(ranks)
            assert tree.tree[1] == (bpe.NONE if low == bpe.NONE else low << tree.bits | ranks.index(low))
            i = rng.randrange(n)
            ranks[i] = rng.choice([bpe.NONE, 1, 2, 3])
            tree.update(i, ranks[i])


# -- Merkle manifest --------------------------------------------------------------------------------------------------

MERKLE = "doc_id long, source string, lang string, n_chars long, text string, lo int, children string, grp string, rank string, path string"


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def plain_manifest(rows):
    sources, trees, out = {}, {}, []
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(encoded, r))), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = plain_levels([x[2] for x in sources[s]])
    top = plain_levels([trees[s][-1][0] for s in order])
    for j, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sources[s]):
            path, folded = plain_path(trees[s], i) + plain_path(top, j), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                folded = sha("".join(map(encoded, (*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))))
            for before, after in path:
                folded = sha(before + folded + after)
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def spark_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "c", "g", "r", "p") for r in rows], MERKLE)
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(docs, {"text": text}).drop("path").collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 273])
def test_manifest_of_one_group(spark, n):
    rows = [(i, "a", "en", 3, f"Text {i}") for i in range(n)]
    assert spark_manifest(spark, rows) == plain_manifest(rows)


def test_manifest_with_nulls_ties_repeats_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([None, *range(300)]), rng.choice([None, "", "b", "é", *["hot"] * 6, *map(str, range(20))]), rng.choice(["de", None]), rng.choice([None, 5]), rng.choice([None, "", "Abc", "Ünd X", "Z" * 50_000]))
        for _ in range(600)
    ]
    rows += [(9, "z", "x", 1, "same")] * 34
    got = spark_manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 3


def test_manifest_finds_a_changed_record_only(spark):
    docs = spark.createDataFrame([(i, "a", "en", 3, f"t{i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(docs, {"lang": F.when(F.col("doc_id") == 7, "xx").otherwise(F.col("lang"))})
    assert [r.doc_id for r in found.filter("NOT verified").collect()] == [7]
