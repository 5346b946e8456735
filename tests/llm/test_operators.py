"""Each operator against a plain version on small inputs, and on nulls, empty tables, repeated rows and clashing columns."""

import gzip
import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from casefile_spark.llm import decontaminate, exact_dedup, line_dedup, mixing, quality, queries, secrets, simhash, substrings, token_counts, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rep string, kept string, chain string, code string, batch string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None, source=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", (source or (lambda k: f"s{k % 3}"))(k), len(t or ""), 1, "r", "k", "c", "c", "b") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeér") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = [*base, *base[:5], *(f"{t}\n{shared} {t[:50]}" for t in base[5:15]), None, "", " ", "\t\n", base[0].replace(" ", " \n "), " ".join(["x y"] * 40), " ".join(["x y"] * 41)]
    rng.shuffle(out)
    return out


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_exact_duplicates_against_a_dictionary(spark, texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    want = {i: (g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for limit in (exact_dedup.BUCKET_BYTES, 500):  # the small one recurses
        assert {r[0]: tuple(r[1:]) for r in exact_dedup.exact_duplicates(docs_of(spark, texts), limit).collect()} == want


def test_exact_duplicates_keep_one_of_repeated_rows(spark):
    docs = docs_of(spark, ["a b", "a  b", "a b", None, "", "c"], ids=[4, 4, 2, None, None, None])
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in rows) == {(2, 3, True): 1, (2, 3, False): 2, (None, 2, True): 1, (None, 2, False): 1, (None, 1, True): 1}
    kept = exact_dedup.first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "c"), (2, "a b")]


def test_open_addressing_compares_contents(monkeypatch):
    monkeypatch.setattr(exact_dedup.xxhash, "xxh3_64_intdigest", lambda b: 5)
    table = exact_dedup.ContentTable()
    assert [table.place(str(i % 900).encode()) for i in range(1800)] == [(i % 900, i < 900) for i in range(1800)]


def brute_repeats(pairs, window):
    first = {}
    for i, t in pairs:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in pairs:
        w = words(t)
        gone = {k + o for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for o in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for n, x in enumerate(w) if n not in gone).encode()).hexdigest())
    return out


def test_repeats_against_all_windows(spark, texts):
    got = substrings.remove_repeats(docs_of(spark, texts), with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_repeats(list(enumerate(texts)), 13)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_tree_nodes_are_repeats_of_several_documents():
    rng = random.Random(3)
    rows = sorted((" ".join(rng.choice("ab") for _ in range(6)), d) for d in range(40) for _ in range(3))
    nodes = substrings.tree_nodes(((s, hash(s), d, d) for s, d in rows), 6)
    want = {}
    for s, d in rows:
        want.setdefault(hash(s), set()).add(d)
    assert sorted(nodes) == sorted((c, min(d), max(d)) for c, d in want.items() if len(d) > 1)


def test_repeats_leave_one_id_and_null_ids_alone(spark):
    long = " ".join(f"w{i}" for i in range(20))
    rows = substrings.remove_repeats(docs_of(spark, [long, long, long, "short", None], ids=[3, 3, None, 1, 2])).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(1, 0), (2, 0), (3, 0), (3, 0), (99, 20)]


def test_simhash_components_against_all_pairs(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), simhash.Ring()).collect()
    forest = [simhash._Forest(len(fps)), simhash._Forest(len(fps))]
    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3
        forest[0].link(signed.index(r.a), signed.index(r.b))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                forest[1].link(i, j)
    assert [forest[0].find(i) for i in range(len(fps))] == [forest[1].find(i) for i in range(len(fps))]


def test_simhash_of_blank_texts_is_zero(spark):
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, [None, " ", "One two", "one TWO", "x"], ids=[7, 5, 1, 2, 3])).collect()}
    assert rows[7].fingerprint == rows[5].fingerprint == "0" * 16 and rows[7].component_id == 5
    assert rows[1].fingerprint == rows[2].fingerprint and rows[2].component_id == 1
    assert int(rows[1].fingerprint, 16) == simhash.xxhash.xxh64_intdigest(b"one two", 42)


def test_similar_documents_find_near_copies_alone(spark):
    rng = random.Random(2)
    base = [[f"word{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(30)]
    near = [[*w[:100], "changed", *w[101:]] for w in base[:10]]
    docs = docs_of(spark, [" ".join(w) for w in base + near] + [None, "", "a b"])
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert found == {i: i % 30 for i in [*range(10), *range(30, 40)]}
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == [*range(30), 40, 41, 42]


def test_the_near_duplicate_stage_is_simhash(spark):
    """The stage drops what fingerprints within three bits link, and nothing else."""
    rng = random.Random(5)
    base = [[f"word{rng.randint(0, 5000)}" for _ in range(2000)] for _ in range(12)]
    texts = [" ".join(w) for w in base + [[*w[:70], "x", *w[71:]] for w in base]] + [None, " ", "", "one two", "One TWO"]
    docs = docs_of(spark, texts)
    prints = [simhash.fingerprint((t or "").lower().encode().split(), 3) for t in texts]
    forest = simhash._Forest(len(texts))
    for j in range(len(texts)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and (texts[i] or "").strip() and (texts[j] or "").strip():
                forest.link(i, j)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [i for i in range(len(texts)) if forest.find(i) == i]
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want and {24, 25, 26, 27} <= {*want} and len(want) < 22


def brute_similar(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (words((t or "").lower()) for t in texts)]
    forest, linked = simhash._Forest(len(texts)), set()
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a & b and len(a & b) >= 0.8 * len(a | b):
                forest.link(i, j)
                linked |= {i, j}
    return {i: forest.find(i) for i in linked}


def similar_texts():
    """Short texts of the same words, in other orders and with edits, with a line in all, and copies around a common base."""
    rng = random.Random(11)
    say = lambda n: [f"longword{rng.randint(0, 300)}" for _ in range(n)]
    out = []
    for n in (3, 5, 13, 16, 22, 30, 60, 150):
        for _ in range(6):
            w = say(n)
            out += [w, [*w[:-1], "changed"], ["changed", *w[1:]], [*w, "a", "b"], rng.sample(w, n), [*w[: n // 2], "x", *w[n // 2 :]], w]
    rows = [[f"{k:02d}" for k in range(40)] for _ in range(60)]
    for i, w in enumerate(rows):  # all differ in words of under five letters alone, half of them in order
        w[i % 40] = f"n{i}"
        if i % 2:
            rng.shuffle(w)
    base = say(100)
    for i in range(40):  # like the base, not like one another
        w = list(base)
        for k in rng.sample(range(4, 96), 2):
            w[k] = f"own{i}"
        rows.append(w)
    line = [f"license{k}" for k in range(12)]
    return [" ".join(w) for w in out + rows + [base] + [line + say(rng.randint(5, 60)) for _ in range(60)]] + [None, "", " "]


@pytest.mark.parametrize("block,common", [(1024, 500_000), (7, 0)])
def test_similar_documents_against_all_pairs(spark, monkeypatch, block, common):
    monkeypatch.setattr(simhash, "PAIR_BLOCK", block)
    monkeypatch.setattr(simhash, "COMMON_CODES", common)
    texts = similar_texts()
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    assert found == brute_similar(texts) and len(found) > 200


def test_leaders_do_not_depend_on_batches():
    rng = random.Random(12)
    rows = sorted((rng.randrange(40), rng.randint(5, 60), d, rng.randrange(3)) for d in range(300))
    batch = lambda part: simhash.pa.RecordBatch.from_arrays([simhash.pa.array(c, simhash.pa.int64()) for c in zip(*part)], names=["code", "n", "doc_id", "at"])
    count = Counter(r[0] for r in rows)
    for size in (1, 2, 7, 300):
        got = [tuple(r.values()) for b in simhash._led(0.8)(batch(rows[k : k + size]) for k in range(0, 300, size)) for r in b.to_pylist()]
        assert [g[:4] for g in got] == [r for r in rows if count[r[0]] > 1]


def test_mixing_meets_targets_and_repeats_itself(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(900)] + [None]
    docs = docs_of(spark, texts, source=lambda k: "big" if k % 3 else [None, "a", "b", "c"][k // 3 % 4])
    one, two = ({r.doc_id: r for r in mixing.mix(docs).collect()} for _ in range(2))
    assert one == two
    total, taken = Counter(), Counter()
    for r in one.values():
        assert 0 <= r.taken <= 3 * r.size and r.size == len(words(texts[r.doc_id]))
        total[r.source] += r.size
        taken[r.source] += r.taken
    for r in one.values():
        assert r.source_size == total[r.source] and abs(taken[r.source] - r.target) <= 1 and r.target <= 3 * r.source_size
    assert abs(sum({r.source: r.target for r in one.values()}.values()) - sum(total.values())) < 1e-6


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 500, "c": 3, "d": 400, None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        for s in over or free:
            want[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(want[s] for s in over)
        free = free - over if over else set()
    assert got == pytest.approx(want)


def test_warc_round_trip(spark):
    body = "<p>é</p>" * 30
    pages = spark.createDataFrame([(3, "http://a\n/é", body), (1, None, body), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "n", body), (6, "e", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.archive_and_read(pages.selectExpr("*", "1 AS offset", "2 AS file"), payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1), 6: ("response", None)}
    assert bytes(rows[1].payload).decode() == body and rows[3].payload is None
    for r, text in ((rows[3], body), (rows[2], "small"), (rows[5], "")):
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha256(text.encode()).hexdigest())
    assert rows[3].url == "http://a%0A/é"


def test_byte_ranges_merge_neighbours():
    assert warc.byte_ranges([(0, 10), (10, 5), (20, 5), (1000, 5)], gap=5, most=100) == [(0, 3, 0, 25), (3, 4, 1000, 5)]
    assert warc.byte_ranges([(0, 10), (10, 5), (15, 90)], gap=5, most=20) == [(0, 2, 0, 15), (2, 3, 15, 90)]
    warc_head, http, payload = warc.parse(gzip.decompress(gzip.compress(warc.record(1, "u", b"\r\n\r\nx", "d", None, False))))
    assert (warc_head["warc-type"], http["content-length"], payload) == ("response", "5", b"\r\n\r\nx")


@pytest.mark.parametrize("text,want", [
    ("", []), ("password = 'hunter22'", [(0, 0, 20)]), ("secret=token:abcdefg", []), ("PASSWD:\"abc.def=\" api_key=xyz", [(0, 0, 16)]),
    ("é AKIA" + "A" * 16, [(2, 1, 22)]), ("AKIA" + "A" * 15, []), ("x" + "0f" * 12 + "z" + "a" * 23, [(1, 2, 25)]), ("ſecret=abcdefgh", []),
])
def test_base_spans(text, want):
    assert secrets.base_spans(text) == want


def test_novel_strings_are_reported_and_words_are_not(spark):
    rng = random.Random(4)
    random_key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    prose = "the private key of the configuration_manager_factory is read by configuration_manager_factory again " * 3
    texts = [f"{prose} private key {random_key} {prose}", prose, None, f"plain words only {random_key}"]
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, texts)).collect()}
    at = texts[0].index(random_key)
    assert f"novel:{at}:{at + 40}" in rows[0].spans.split(",")
    assert [rows[i].spans for i in (1, 2, 3)] == ["", "", ""]
    assert rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_secret_in_many_copies_is_still_reported(spark):
    rng = random.Random(14)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    leaked, dashed = "x" + "".join(rng.choice(letters) for _ in range(35)), "-".join("q" + "".join(rng.choice(letters) for _ in range(10)) for _ in range(4))
    copies = [f"the private key is {leaked} and the bearer is {dashed} as said", *(f"note {i}: private key {leaked} bearer {dashed} end" for i in range(9))] * 3
    plain = ["the private key of configuration_manager_factory"] * 2 + ["private key for configuration_manager_factory"]
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, copies + plain)).collect()}
    for i, text in enumerate(copies):
        assert [f"novel:{text.index(x)}:{text.index(x) + len(x)}" for x in (leaked, dashed)] == rows[i].spans.split(",")
    assert [rows[i].spans for i in range(30, 33)] == [""] * 3


def test_token_histogram_answers_every_limit(spark, texts):
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts]
    table = token_counts.length_histogram(token_counts.encoded_lengths(docs_of(spark, texts)))
    for r in table.collect():
        assert r.n_docs == lengths.count(r.length) and r.total_tokens == sum(lengths)
        assert r.longer_docs == sum(n > r.length for n in lengths) and r.truncated_tokens == sum(min(n, r.length) for n in lengths)
    assert token_counts.truncated_totals(table, [0, 10, 10**9]).first() == (0, sum(min(n, 10) for n in lengths), sum(lengths))
    assert token_counts.quantile(table, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]


def test_decontamination_finds_whole_items(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, f"{say(20 + i)}. {say(8)}.") for i in range(12)] + [(90, ""), (91, None), (92, "Only.")]
    held = [f"{say(200)} {t.upper()} {say(100)}" for _, t in items[:6]]
    parts = [f"{say(100)} {t.split('.')[0]} {say(100)}" for _, t in items[6:12]]  # question without answer
    docs = docs_of(spark, [*held, *parts, None, "", say(300)])
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(i, i) for i in range(6)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()) == list(range(6, 15))
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(16)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items, docs = [], []
    for i, (q, a) in enumerate([(20, 8), (14, 9), (49, 1), (25, 2), (40, 5)]):
        question, answer = say(q), say(a)
        items.append((i, f"{' '.join(question)}. {' '.join(answer)}."))
        edits = [[*question[: q // 2], "edited", *question[q // 2 + 1 :], *answer], [*question, *answer[: a // 2], "edited", *answer[a // 2 + 1 :]]]
        if a <= 2:
            edits.append(question)
        docs += [(i, [*say(100), *e, *say(100)]) for e in edits]
        docs.append((None, [*say(100), *question[: q // 2], *say(100)]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, [" ".join(w) for _, w in docs]), bench).collect()}
    assert got == {(d, i) for d, (i, _) in enumerate(docs) if i is not None}


def test_block_bounds_lose_no_item():
    rng = random.Random(8)
    np = decontaminate.np
    items = [sorted({rng.randrange(60) for _ in range(9)}) for _ in range(70)]
    postings = sorted((t, i, rng.random() / 3) for i, ts in enumerate(items) for t in ts)
    terms = sorted({t for t, _, _ in postings})
    shard = decontaminate.Shard(np.array(terms, np.uint64), np.searchsorted([terms.index(t) for t, _, _ in postings], np.arange(len(terms) + 1)), np.array([i for _, i, _ in postings]), np.array([w for *_, w in postings]), [(i, 1, None, None) for i in range(70)])
    pairs = sorted({(p, rng.randrange(len(terms))) for p in range(40) for _ in range(12)})
    got = {(p, i) for p, i, _ in zip(*shard.search(np.array([t for _, t in pairs]), np.array([p for p, _ in pairs]), 40))}
    score = Counter()
    for p, t in pairs:
        for u, i, w in postings:
            if u == terms[t]:
                score[p, i] += w
    assert got == {k for k, v in score.items() if v >= 1} and got


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    train = labels.filter("doc_id % 3 <> 0")
    scored = quality.classify(docs, train).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("quality", "label"), "doc_id").collect()
    assert sum((r.label == 1) == r.keep for r in scored) >= 0.97 * len(scored) > 0
    assert quality.good_documents(docs, train).columns == docs.columns


def test_quality_without_two_classes_keeps_all(spark, texts):
    docs = docs_of(spark, texts)
    for rows in ([], [(1, 1)], [(None, 1), (2, None)]):
        assert all(r.keep for r in quality.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect())


def test_lines_with_a_common_template_are_dropped(spark):
    texts = [f"User {i} logged in from host {i * 7}\n\n{chr(97 + i) * 5} stands here alone" for i in range(8)] + [None, "", "alone"]
    rows = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert [(rows[i].n_lines, rows[i].n_dropped) for i in (0, 8, 9, 10)] == [(3, 1), (0, 0), (1, 0), (1, 0)]
    assert rows[3].kept_text == "\nddddd stands here alone" and rows[8].kept_text is None and rows[9].kept_text == ""


def test_lines_of_one_document_do_not_recur(spark):
    log = "\n".join(f"step {i} done" for i in range(9))
    names = "\n".join(f"the same words before {chr(97 + i) * 4}" for i in range(9))
    both = [f"part {i} of it\npart {i + 50} of it" for i in range(4)]  # four documents, eight lines
    texts = [log, names, *both, *(f"user {i} came in\nuser {i + 50} came in" for i in range(5))]
    plain = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert plain == {i: 0 for i in range(6)} | {i: 2 for i in range(6, 11)}


def test_dedup_stages_with_clashing_columns(spark):
    """Columns named as the operators' own pass through, whichever join is chosen."""
    texts = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58)), "other text of some words here"]
    docs = docs_of(spark, texts).withColumnsRenamed({"size": "g", "rep": "gone", "kept": "__id", "chain": "s", "code": "component_id"})
    copies = exact_dedup.first_copies(docs)
    assert copies.columns == docs.columns and sorted(r.doc_id for r in copies.collect()) == [0, 2, 3]
    groups = simhash.one_of_each_group(docs)
    assert groups.columns == docs.columns and sorted(r.doc_id for r in groups.collect()) == [0, 3]


def test_line_dedup_sql_counts_documents(spark, tmp_path):
    """A fixture where lines and documents differ: the SQL and the operator agree on it."""
    import duckdb

    log = "\n".join(f"step {i} done" for i in range(9))
    both = [f"part {i} of it\npart {i + 50} of it" for i in range(4)]
    texts = [log, *both, *(f"user {i} came in\nuser {i + 50} came in\n\nword {chr(97 + i)} x y z" for i in range(5)), None, "", "w" * 200_000 + " x y", "\n\n"]
    docs_of(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({queries.SQL['op10_line_dedup']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in queries.op10_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == want
    assert sum(w[2] for w in want) == 10


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        exact_dedup.exact_duplicates(docs), exact_dedup.first_copies(docs), substrings.remove_repeats(docs), simhash.near_duplicates(docs), simhash.one_of_each_group(docs),
        mixing.mix(docs), secrets.scan_secrets(docs), token_counts.length_histogram(token_counts.encoded_lengths(docs)), line_dedup.drop_recurring_lines(docs),
        quality.classify(docs, none), warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "source_mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = now
    assert docs.count() > 50
