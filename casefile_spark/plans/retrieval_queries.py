"""Registered retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import retrieval as R
from ..operators import vectorise as V
from ..session import shared_folder
from . import bindings as B

# Shared SQL: unit vectors, mean vector per label, exact scores of every (query, vector) pair.
_CENTROIDS = """
parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY label, i),
centroids AS (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY label)"""
_BY_LABEL = f"""{_CENTROIDS},
scored AS (SELECT c.query_id, e.vec_id, e.label,
  round(list_cosine_similarity(c.q, e.embedding::DOUBLE[]), 12) AS score FROM centroids c, embeddings e)"""
_CORPUS = """
chunks AS (SELECT d.doc_id, d.source || '-' || d.lang AS collection,
  regexp_extract(d.source, '(\\d+)$', 1)::INT * 10 + list_position(['de','en','es','fr'], d.lang) AS collection_pos,
  e.embedding, d.source || '.pdf' AS source, 'p.' || length(d.text) AS locator, d.text
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
requested AS (SELECT DISTINCT doc_id % 10 AS query_id, source || '-' || lang AS collection,
  regexp_extract(source, '(\\d+)$', 1)::INT * 10 + list_position(['de','en','es','fr'], lang) AS collection_pos
  FROM documents)"""
_RANKED = f"""{_CENTROIDS},{_CORPUS},
scored AS (SELECT c.query_id, k.*, round(list_cosine_similarity(c.q, k.embedding::DOUBLE[]), 12) AS score
  FROM centroids c, chunks k),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection_pos, doc_id) AS rank
  FROM scored QUALIFY rank <= 14)"""


def _hits(spark, sf, k=14):
    return R.search_across(B.corpus(spark, sf), B.centroid_queries(spark, sf, k))


def _passages(spark, sf, k=14):
    return R.with_passages(_hits(spark, sf, k), B.corpus(spark, sf))


def d1_l2_normalise(spark, sf):
    e = B.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") * 1.0))
    unit = vectors.l2_normalise(scaled)
    return e.select(
        "vec_id", F.round(vectors.norm(unit), 6).alias("length"), F.round(unit[0], 6).alias("x0"),
        F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


def d2_top_k_one_collection(spark, sf):
    """Each centroid against the vectors of its own label only."""
    e = B.vectors_table(spark, sf)
    queries = B.centroid_queries(spark, sf, 5)
    own = queries.select("query_id", F.concat(F.lit("c"), F.col("query_id").cast("string")).alias("collection"), F.col("query_id").alias("collection_pos"))
    return R.search_per_file(e, queries, own).select("query_id", "rank", F.col("chunk_key").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


def d2_search_one(spark, sf):
    """All centroids against the vectors of one label."""
    hits = R.search_one(B.vectors_table(spark, sf), "c3", B.centroid_queries(spark, sf, 5))
    return hits.select("query_id", "rank", F.col("chunk_key").cast("long").alias("vec_id"), F.round("score", 6).alias("score"))


def _cut_vectors(spark, sf):
    """The vectors of every third label cut to half their size, as from another model."""
    half = F.slice("embedding", F.lit(1), (F.size("embedding") / 2).cast("int"))
    e = B.vectors_table(spark, sf)
    return e.withColumn("embedding", F.when(F.col("collection_pos") % 3 == 1, half).otherwise(F.col("embedding")))


def d3_other_size_vectors(spark, sf):
    """Collections of another vector size are reported as skipped, the rest is ranked."""
    cut, queries = _cut_vectors(spark, sf), B.centroid_queries(spark, sf, 14)
    asked = cut.select((F.col("chunk_no") % 7).alias("query_id"), "collection", "collection_pos").distinct()
    report = R.coverage_report(asked, R.readable(cut, len(queries.first()["embedding"])))
    hits = R.search_across(cut, queries).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 6).alias("total"))
    return report.join(hits, "query_id").select("query_id", "attempted", "answered", F.array_join("skipped", ",").alias("skipped"), "hits", "total")


def d3_scatter_gather_top_k(spark, sf):
    hits = R.search_across(B.vectors_table(spark, sf), B.centroid_queries(spark, sf, 14))
    return hits.select(
        "query_id", "rank", "collection", F.col("chunk_key").cast("long").alias("vec_id"), F.round("score", 6).alias("score")
    )


def d4_top_k_per_file(spark, sf):
    per_file = R.search_per_file(B.corpus(spark, sf), B.centroid_queries(spark, sf, 3), B.requested(spark, sf))
    g = R.grouped_hits(per_file)
    return g.select(
        "query_id", "collection", F.size("hits").alias("hits"),
        F.array_join(F.transform("hits", lambda h: h["chunk_key"]), ",").alias("chunk_keys"),
    )


def d5_compare_depth(spark, sf):
    """A comparison over the files of every matter and language, an override where the language is Spanish."""
    d = B.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").cast("int").alias("n_files"))
    req = d.select(
        F.concat_ws("-", "source", "lang").alias("query_id"), "n_files", F.lit(6).alias("base_depth"),
        F.when(F.col("lang") == "es", 9).alias("override"),
    )
    return R.compare_plan(req).select("query_id", "n_files", "depth", "refusal", "over_budget")


def d6_answer_depth(spark, sf):
    o = B.table(spark, sf, "orders")
    override = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("int") % 7 + 1)
    detail = F.when(F.col("o_orderpriority") == "1-URGENT", "Detailed").when(F.col("o_orderpriority") == "2-HIGH", "Concise")
    base = F.when(F.col("o_orderpriority") == "5-LOW", 8).otherwise(14)
    return o.select(F.col("o_orderkey").alias("request_id"), R.answer_depth(override, detail, base).alias("depth"))


def d7_coverage_report(spark, sf):
    report = R.coverage_report(B.requested(spark, sf), B.corpus(spark, sf))
    checked = R.require_coverage(report)
    return checked.select("query_id", "attempted", "answered", F.array_join("skipped", ",").alias("skipped"))


def d8_partial_warning(spark, sf):
    report = R.coverage_report(B.requested(spark, sf), B.corpus(spark, sf))
    d = B.table(spark, sf, "documents")
    manifest = d.groupBy(B.collection_of(F.col("source"), F.col("lang")).alias("collection")).agg(
        F.concat(F.lit("file-"), F.min("doc_id").cast("string"), F.lit(".pdf")).alias("filename")
    )
    return R.partial_warning(report, manifest)


def d9_contributors(spark, sf):
    return R.contributors(_passages(spark, sf), ["source"])


def d10_citation_list(spark, sf):
    return R.citation_list(_passages(spark, sf))


def d11_gather_files(spark, sf):
    """All chunks of all requested files, folded to one check value per file."""
    rows = R.gather_chunks(B.requested(spark, sf), B.corpus(spark, sf))
    return rows.groupBy("query_id", "collection").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"),
        F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"),
    )


def d12_coverage_share(spark, sf):
    sent = _hits(spark, sf)
    scope = R.scope_sizes(B.requested(spark, sf), B.corpus(spark, sf))
    out = R.coverage_share(sent, scope, ["query_id"])
    return out.withColumn("share", F.round("share", 6))


def d13_text_query_top_k(spark, sf):
    """Benchmark passages as text queries against all documents, on a vectoriser fitted on these, saved and loaded again."""
    d, folder = B.table(spark, sf, "documents"), shared_folder(spark, "vectoriser")
    V.save(V.fit_vectoriser(d, "text", dim=512), spark, folder)
    model = V.load(spark, folder)
    chunks = V.vectorise(model, d).select(
        F.col("source").alias("collection"), B.matter_of(F.col("source")).alias("collection_pos"),
        F.col("doc_id").alias("chunk_no"), F.col("doc_id").cast("string").alias("chunk_key"), "embedding",
    )
    q = V.vectorise(model, B.table(spark, sf, "benchmark")).select(
        F.col("item_id").alias("query_id"), F.lit(5).alias("k"), "embedding"
    )
    return R.search_across(chunks, q).select("query_id", "rank", "chunk_key", F.round("score", 6).alias("score"))


def d14_vector_parity(spark, sf):
    """Vectors as stored against the same vectors coarsened to three digits."""
    e = B.vectors_table(spark, sf)
    coarse = e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
    out = R.vector_parity(e, coarse, ["collection"])
    return out.select(
        "collection", "vectors", F.round("min_cosine", 6).alias("min_cosine"), F.round("mean_cosine", 6).alias("mean_cosine"), "parity"
    )


def d14_ranking_parity(spark, sf):
    e = B.vectors_table(spark, sf)
    coarse = e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)))
    q = B.centroid_queries(spark, sf, 14)
    return R.ranking_parity(R.search_across(e, q), R.search_across(coarse, q))


QUERIES = {f.__name__: f for f in (
    d1_l2_normalise, d2_top_k_one_collection, d2_search_one, d3_other_size_vectors, d3_scatter_gather_top_k, d4_top_k_per_file, d5_compare_depth,
    d6_answer_depth, d7_coverage_report, d8_partial_warning, d9_contributors, d10_citation_list, d11_gather_files,
    d12_coverage_share, d13_text_query_top_k, d14_vector_parity, d14_ranking_parity,
)}

SQL = {
    "d1_l2_normalise": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s),
u AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM n)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS x0,
  round(list_sum(u), 6) AS total FROM u""",
    "d2_top_k_one_collection": f"""
WITH {_BY_LABEL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id,
  round(score, 6) AS score FROM scored WHERE label = query_id QUALIFY rank <= 5""",
    "d2_search_one": f"""
WITH {_BY_LABEL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id,
  round(score, 6) AS score FROM scored WHERE label = 3 QUALIFY rank <= 5""",
    "d3_other_size_vectors": f"""
WITH {_BY_LABEL},
asked AS (SELECT DISTINCT vec_id % 7 AS query_id, label FROM embeddings),
r AS (SELECT query_id, count(*) AS attempted, count(*) FILTER (label % 3 <> 1) AS answered,
  coalesce(string_agg('c' || label, ',' ORDER BY label) FILTER (label % 3 = 1), '') AS skipped FROM asked GROUP BY 1),
t AS (SELECT query_id, score FROM scored WHERE label % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, vec_id) <= 14),
h AS (SELECT query_id, count(*) AS hits, round(sum(score), 6) AS total FROM t GROUP BY 1)
SELECT query_id, attempted, answered, skipped, hits, total FROM r JOIN h USING (query_id)""",
    "d3_scatter_gather_top_k": f"""
WITH {_BY_LABEL}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, vec_id) AS rank,
  'c' || label AS collection, vec_id, round(score, 6) AS score FROM scored QUALIFY rank <= 14""",
    "d4_top_k_per_file": f"""
WITH {_CENTROIDS},{_CORPUS},
s AS (SELECT c.query_id, k.collection, k.doc_id, row_number() OVER (PARTITION BY c.query_id, k.collection
   ORDER BY round(list_cosine_similarity(c.q, k.embedding::DOUBLE[]), 12) DESC, k.doc_id) AS rank
   FROM centroids c, chunks k QUALIFY rank <= 3)
SELECT r.query_id, r.collection, count(s.doc_id) AS hits,
  coalesce(string_agg(s.doc_id::VARCHAR, ',' ORDER BY s.rank), '') AS chunk_keys
FROM requested r LEFT JOIN s USING (query_id, collection) GROUP BY r.query_id, r.collection""",
    "d5_compare_depth": """
WITH g AS (SELECT source || '-' || lang AS query_id, count(*)::INT AS n_files,
  CASE WHEN lang = 'es' THEN 9 END AS o FROM documents GROUP BY source, lang),
d AS (SELECT query_id, n_files, CASE WHEN n_files BETWEEN 2 AND 20 THEN coalesce(o, greatest(3, least(6, 40 // n_files))) END AS depth
  FROM g)
SELECT query_id, n_files, depth,
  CASE WHEN n_files < 2 THEN 'Compare Clauses needs at least 2 documents to compare; ' || n_files || ' selected.'
       WHEN n_files > 20 THEN 'Compare Clauses is limited to 20 files; ' || n_files || ' selected. Use the file selector to restrict the comparison to at most 20 files.' END AS refusal,
  depth * n_files > 40 AS over_budget FROM d""",
    "d6_answer_depth": """
SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 7 + 1
  WHEN o_orderpriority = '1-URGENT' THEN 28 WHEN o_orderpriority = '5-LOW' THEN 8 ELSE 14 END AS depth FROM orders""",
    "d7_coverage_report": f"""
WITH {_CORPUS}, ok AS (SELECT DISTINCT collection FROM chunks)
SELECT query_id, count(*) AS attempted, count(ok.collection) AS answered,
  coalesce(string_agg(r.collection, ',' ORDER BY collection_pos) FILTER (ok.collection IS NULL), '') AS skipped
FROM requested r LEFT JOIN ok ON ok.collection = r.collection GROUP BY query_id""",
    "d8_partial_warning": f"""
WITH {_CORPUS}, ok AS (SELECT DISTINCT collection FROM chunks),
names AS (SELECT source || '-' || lang AS collection, 'file-' || min(doc_id) || '.pdf' AS filename FROM documents GROUP BY 1),
g AS (SELECT query_id, count(*) AS attempted, count(ok.collection) AS answered,
  string_agg(filename, ', ' ORDER BY collection_pos) FILTER (ok.collection IS NULL) AS names
  FROM requested r LEFT JOIN ok ON ok.collection = r.collection LEFT JOIN names n ON n.collection = r.collection GROUP BY query_id)
SELECT query_id, attempted, answered, CASE WHEN names IS NOT NULL THEN
  'Retrieved from ' || answered || ' of ' || attempted || ' files. ' || (attempted - answered) ||
  ' file(s) could not be read from the search index and did not contribute to this answer: ' || names ||
  '. Open the matter to re-process them.' END AS warning FROM g""",
    "d9_contributors": f"""
WITH {_RANKED}
SELECT query_id, source, min(rank) AS first_rank, count(*) AS passages,
  row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS position FROM hits GROUP BY query_id, source""",
    "d10_citation_list": f"""
WITH {_RANKED},
first AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, locator ORDER BY rank) AS n FROM hits QUALIFY n = 1),
flat AS (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS t FROM first)
SELECT query_id, source, locator, rank, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '...' ELSE t END AS snippet FROM flat""",
    "d11_gather_files": f"""
WITH {_CORPUS}
SELECT query_id, collection, count(*) AS chunks, sum(length(text)) AS chars, min(doc_id) AS first_chunk, max(doc_id) AS last_chunk
FROM requested JOIN chunks USING (collection) GROUP BY query_id, collection""",
    "d12_coverage_share": f"""
WITH {_RANKED},
a AS (SELECT query_id, count(*) AS sent FROM hits GROUP BY query_id),
b AS (SELECT query_id, count(*) AS in_scope FROM requested JOIN chunks USING (collection) GROUP BY query_id)
SELECT query_id, coalesce(sent, 0) AS sent, in_scope, round(coalesce(sent, 0) / in_scope, 6) AS share FROM b LEFT JOIN a USING (query_id)""",
    "d13_text_query_top_k": """
WITH both_sides AS (SELECT doc_id AS id, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS pos, coalesce(text, '') AS text, true AS doc FROM documents
  UNION ALL SELECT item_id, 0, coalesce(text, ''), false FROM benchmark),
words AS (SELECT id, doc, unnest(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: length(x) >= 2)) AS word FROM both_sides),
buckets AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS b FROM (SELECT DISTINCT word FROM words)),
tf AS (SELECT id, doc, b, count(*)::DOUBLE AS n FROM words JOIN buckets USING (word) GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS w FROM tf WHERE doc GROUP BY b),
v AS (SELECT id, doc, b, n * w AS x FROM tf JOIN idf USING (b)),
len AS (SELECT id, doc, sqrt(sum(x * x)) AS l FROM v GROUP BY ALL),
dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.x * d.x) AS s FROM v q JOIN v d ON q.b = d.b AND d.doc AND NOT q.doc GROUP BY ALL),
pairs AS (SELECT q.id AS query_id, d.id AS doc_id, d.pos FROM (SELECT id FROM both_sides WHERE NOT doc) q, (SELECT id, pos FROM both_sides WHERE doc) d),
scored AS (SELECT p.query_id, p.doc_id, p.pos, round(coalesce(s / nullif(a.l * c.l, 0), 0), 12) AS score FROM pairs p
  LEFT JOIN dots USING (query_id, doc_id) LEFT JOIN len a ON a.id = p.query_id AND NOT a.doc LEFT JOIN len c ON c.id = p.doc_id AND c.doc)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, doc_id) AS rank, doc_id::VARCHAR AS chunk_key, round(score, 6) AS score
FROM scored QUALIFY rank <= 5""",
    "d14_vector_parity": """
WITH p AS (SELECT 'c' || label AS collection, list_cosine_similarity(embedding::DOUBLE[],
  list_transform(embedding::DOUBLE[], lambda x: round(x, 3))) AS c FROM embeddings)
SELECT collection, count(*) AS vectors, round(min(c), 6) AS min_cosine, round(avg(c), 6) AS mean_cosine,
  min(c) >= 0.9999 AS parity FROM p GROUP BY collection""",
    "d14_ranking_parity": f"""
WITH {_CENTROIDS},
both_sets AS (SELECT 0 AS side, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT 1, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: round(x, 2)) FROM embeddings),
r AS (SELECT c.query_id, side, vec_id, row_number() OVER (PARTITION BY c.query_id, side
   ORDER BY round(list_cosine_similarity(c.q, v), 12) DESC, label, vec_id) AS rank FROM centroids c, both_sets QUALIFY rank <= 14),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.vec_id IS NOT DISTINCT FROM b.vec_id AS same
  FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT * FROM r WHERE side = 1) b USING (query_id, rank))
SELECT query_id, count(*) AS ranks, count(*) FILTER (NOT same) AS differing, bool_and(same) AS same_ranking FROM j GROUP BY query_id""",
}
