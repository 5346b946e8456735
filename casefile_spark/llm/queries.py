"""The operators as registered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, line_dedup, merkle, mixing, prefix_trie, quality, secrets, simhash, substrings, token_counts, warc


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(_table(spark, sf, "documents")))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf, "documents"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf, "documents"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf, "conversations"), shared=(100, 6)).drop("node")


def op12_bpe(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(_table(spark, sf, "documents"), vocabulary), vocabulary)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(chosen, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf, "documents"), tampered={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_token_counts, op3_warc, op4_secrets, op5_substring_dedup, op6_simhash, op7_decontamination,
        op8_exact_dedup, op9_mixing, op10_line_dedup, op11_prefix_trie, op12_bpe, op13_merkle,
    )
}

#: Words, as in the operators.
_WORD = r"[^\x20\x09-\x0D]+"



def _crc32(number: str) -> str:
    """Unsigned crc32 of a number's decimal digits, bit by bit."""
    bits = f"flatten(list_transform(string_split(({number})::VARCHAR, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch)::BIGINT >> k::BIGINT) & 1)))"
    step = "lambda s, b: xor(s >> 1, CASE WHEN xor(s, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, {step}), 4294967295)"


def _field(name: str, value: str | None = None) -> str:
    value = f"({value or name})::VARCHAR"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


_RECORD = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels(name: str, first: str, key: str) -> str:
    """All levels of the trees over ``first``'s lists; every 16 nodes become one while several remain."""
    up = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"
    return f"{name} AS ({first} UNION ALL SELECT {key}, level + 1, {up} FROM {name} WHERE len(nodes) > 1)"


def _steps(tree: str, rank: str) -> str:
    """Siblings before and after a node's ancestors, level by level."""
    place = f"({rank} // (16 ** level)::BIGINT)"
    before = f"array_to_string({tree}.nodes[{place} // 16 * 16 + 1 : {place}], '')"
    after = f"array_to_string({tree}.nodes[{place} + 2 : {place} // 16 * 16 + 16], '')"
    return f"list({before} || '|' || {after} ORDER BY level) FILTER (WHERE len({tree}.nodes) > 1)"


SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to
        FROM m""",
    "op5_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
        s AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS seq FROM w, unnest(range(1, greatest(len(words) - 11, 1))) AS u(i)),
        f AS (SELECT seq, min(doc_id) AS low FROM s GROUP BY seq),
        g AS (SELECT DISTINCT s.doc_id, s.i + o AS word_no FROM s JOIN f USING (seq), unnest(range(0, 13)) AS u(o) WHERE f.low < s.doc_id),
        h AS (SELECT doc_id, list(word_no) AS gone FROM g GROUP BY doc_id),
        k AS (
            SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
                   CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
            FROM w LEFT JOIN h ON w.doc_id = h.doc_id)
        SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)""",
    "op9_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                   len(regexp_extract_all(coalesce(text, ''), '[#$%&*|!]'))::DOUBLE AS symbols
            FROM documents),
        k AS (
            SELECT doc_id, source, size,
                   -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                   / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 8.0::DOUBLE * symbols / size::DOUBLE) ELSE 1.0::DOUBLE END) AS key
            FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
            FROM w WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT first(level ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS fair FROM l WHERE NOT cap::DOUBLE / weight < level),
        g AS (
            SELECT source, source_size, CASE WHEN cap::DOUBLE / weight < level THEN cap::DOUBLE ELSE least(coalesce(fair, 0.0) * weight, cap::DOUBLE) END AS target
            FROM l LEFT JOIN f ON TRUE),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
        o AS (
            SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size + 0.5)::BIGINT AS part,
                   coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM o""",
    "op10_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        x AS (SELECT DISTINCT k, unnest(lines) AS line FROM d),
        t AS (SELECT line, list_filter(regexp_split_to_array(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS tokens FROM (SELECT DISTINCT line FROM x)),
        m AS (
            SELECT line, list_transform(tokens, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
            FROM t WHERE len(tokens) > 0),
        f AS (SELECT k, line, tokens, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM x JOIN m USING (line)),
        r AS (SELECT * FROM f WHERE leaf IN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT k) >= 5)),
        p AS (SELECT k, line, leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM r),
        c AS (SELECT leaf, place, token FROM p WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT k) >= 5),
        s AS (
            SELECT p.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.place) AS template, count(c.token) AS constants, count(*) AS n
            FROM (SELECT DISTINCT line, leaf, place, token FROM p) AS p LEFT JOIN c USING (leaf, place, token) GROUP BY p.line, p.leaf),
        h AS (SELECT * FROM s WHERE constants >= 0.5 * n),
        g AS (SELECT line FROM h WHERE template IN (SELECT template FROM h JOIN x USING (line) GROUP BY template HAVING count(DISTINCT k) >= 5)),
        e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d WHERE text IS NOT NULL),
        k AS (
            SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.line)::BIGINT AS n_dropped,
                   coalesce(string_agg(e.line, chr(10) ORDER BY line_no) FILTER (WHERE g.line IS NULL), '') AS kept
            FROM e LEFT JOIN g USING (line) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS said,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        v AS (SELECT c, list(said ORDER BY i) AS turns, ({_crc32("c")} % 6)::BIGINT AS h FROM t GROUP BY c),
        b AS (
            SELECT v.c, list_concat(list_slice(coalesce(base.turns, []), 1, v.h), list_slice(v.turns, v.h + 1, len(v.turns))) AS turns
            FROM v LEFT JOIN v AS base ON base.c = v.c - v.c % 100),
        m AS (SELECT c, d, CASE WHEN d = 0 THEN [] ELSE turns[1 : d] END AS seq, len(turns) = d AS ends FROM b, unnest(range(0, len(turns) + 1)) AS u(d)),
        g AS (
            SELECT seq, d, min(c) AS low, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE length(seq[d].x) END AS chars,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
            FROM m GROUP BY seq, d),
        k AS (SELECT seq[1 : d - 1] AS seq, count(*) AS children FROM g WHERE d > 0 GROUP BY ALL),
        a AS (SELECT g.*, coalesce(children, 0) AS children FROM g LEFT JOIN k USING (seq)),
        s AS (
            SELECT CASE WHEN u.top = 0 THEN [] ELSE a.seq[1 : u.top] END AS seq, sum((children = 0)::INT)::BIGINT AS leaves, sum((n - 1) * chars)::BIGINT AS saved
            FROM a, unnest(range(0, a.d + 1)) AS u(top) GROUP BY ALL)
        SELECT a.low AS conv_id, a.d AS depth, p.low AS parent_conv_id, a.n AS n_convs, a.children AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, a.ends_sha256
        FROM a JOIN s USING (seq) LEFT JOIN g AS p ON a.d > 0 AND p.d = a.d - 1 AND p.seq = CASE WHEN a.d <= 1 THEN [] ELSE a.seq[1 : a.d - 1] END""",
    "op13_merkle": f"""
        WITH RECURSIVE l AS (
            SELECT doc_id, source, sha256(concat({", ".join([*_RECORD, _field("text")])})) AS leaf,
                   CASE WHEN {_crc32("doc_id")} % 5 = 0 THEN sha256(concat({", ".join([*_RECORD, _field("text", _LOWERED)])}))
                        ELSE sha256(concat({", ".join([*_RECORD, _field("text")])})) END AS seen
            FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l),
        {_levels("lv", "SELECT source, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM r GROUP BY source", "source")},
        sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM lv WHERE len(nodes) = 1),
        {_levels("up", "SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub", "").replace("SELECT , level", "SELECT level")},
        top AS (SELECT sub.source, subroot, coalesce({_steps("up", "place")}, []) AS above FROM sub, up GROUP BY sub.source, subroot),
        own AS (
            SELECT r.doc_id, r.source, leaf, seen, rank, coalesce({_steps("lv", "rank")}, []) AS steps
            FROM r JOIN lv ON r.source IS NOT DISTINCT FROM lv.source GROUP BY r.doc_id, r.source, leaf, seen, rank),
        f AS (
            SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM up WHERE len(nodes) = 1) AS root, steps || above AS path, seen
            FROM own JOIN top ON own.source IS NOT DISTINCT FROM top.source),
        e AS (
            SELECT *, list_reduce([seen] || path, lambda digest, step: sha256(split_part(step, '|', 1) || digest || split_part(step, '|', 2))) AS folded_root FROM f)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM e""",
}
