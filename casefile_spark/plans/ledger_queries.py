"""Registered ledger, registry and event queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import registry as K
from ..operators.quality import probe_indexes
from ..sources import cells, eventlog, sinks
from ..sources.catalogues import tier_bounds
from . import bindings as B


def _at(text: str):
    return F.lit(text).cast("timestamp")


# Shared SQL: the same bindings.
_MATTERS = """
matters AS (SELECT c_custkey AS matter_id, c_name AS name,
  TIMESTAMP '1999-12-31 12:00:00' - to_hours(c_custkey::INT) AS created_at,
  CASE WHEN c_nationkey > 12 THEN TIMESTAMP '1999-12-31 12:00:00' - to_days(c_nationkey::INT) END AS last_queried_at,
  CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1999-12-31 12:00:00' - to_hours(2 * c_custkey::INT) END AS deleted_at
  FROM customer WHERE c_mktsegment <> 'FURNITURE')"""
_COSTS = f"""{_MATTERS},
costs AS (SELECT o_orderkey AS id, o_orderdate AS timestamp,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS matter_id,
  CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS matter_name,
  lower(o_orderpriority) AS task_id, 'model-' || lower(o_orderstatus) AS model_used,
  floor(o_totalprice)::BIGINT AS input_tokens, floor(o_totalprice / 10)::BIGINT AS output_tokens,
  CASE WHEN o_orderstatus <> 'P' THEN (floor(o_totalprice)::BIGINT::DECIMAL(11, 0) * 0.000001::DECIMAL(7, 6))::DECIMAL(18, 6) END AS cost_usd,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN floor(o_totalprice) / 8 END AS duration_seconds,
  o_orderstatus = 'F' AS was_exhaustive, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'completed' END AS status,
  o_orderkey::VARCHAR AS run_id FROM orders),
shown AS (SELECT c.*, m.name AS live_name, m.deleted_at AS matter_deleted_at,
  CASE WHEN c.matter_id IS NULL THEN '(no matter)'
    WHEN m.name IS NOT NULL THEN m.name || CASE WHEN m.deleted_at IS NOT NULL THEN ' (deleted)' ELSE '' END
    WHEN c.matter_name IS NOT NULL THEN c.matter_name || ' (removed)'
    ELSE 'Matter ' || c.matter_id || ' (removed)' END AS display_matter
  FROM costs c LEFT JOIN matters m ON m.matter_id = c.matter_id)"""
_FILES = """
files AS (SELECT d.doc_id AS file_id, regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id,
  CASE WHEN lang = 'en' THEN strftime(DATE '2020-01-01' + (n_chars % 1500)::INT, '%Y-%m-%d') || ' - en_' || d.doc_id || '.pdf'
    ELSE lang || '_' || d.doc_id || '.docx' END AS filename,
  sha256(text) AS content_sha256,
  'm' || regexp_extract(source, '(\\d+)$', 1) || '-' || substr(sha256(text), 1, 16) AS collection,
  CASE WHEN length(text) < 200 THEN 'failed_no_text' WHEN quality = 0 THEN 'ocr_low_quality' ELSE 'ingested' END AS ingest_status,
  CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-15 00:00:00' - to_hours(d.doc_id::INT) END AS deleted_at,
  TIMESTAMP '2023-01-01 00:00:00' + to_minutes(d.doc_id::INT) AS created_at, lang, quality = 0 AS scanned,
  length(text) AS chars FROM documents d LEFT JOIN labels l USING (doc_id))"""
_FILE_MATTERS = """
doc_matters AS (SELECT regexp_extract(source, '(\\d+)$', 1)::BIGINT AS matter_id, source AS name, max(n_chars) AS n,
  CASE WHEN max(n_chars) % 3 = 0 THEN TIMESTAMP '2024-01-10 06:00:00' - to_hours((max(n_chars) % 1000)::INT) END AS deleted_at,
  TIMESTAMP '2023-01-01 00:00:00' + to_seconds(min(doc_id)) AS created_at,
  CASE WHEN max(n_chars) % 2 = 0 THEN TIMESTAMP '2023-06-01 00:00:00' + to_seconds(max(n_chars)) END AS last_queried_at
  FROM documents GROUP BY source)"""


def doc_matters(spark, sf):
    d = B.table(spark, sf, "documents")
    n = F.max("n_chars")

    def at(text, seconds):
        return F.timestamp_seconds(F.unix_timestamp(_at(text)) + seconds)

    return d.groupBy("source").agg(
        B.matter_of(F.first("source")).alias("matter_id"),
        F.when(n % 3 == 0, at("2024-01-10 06:00:00", -(n % 1000) * 3600)).alias("deleted_at"),
        at("2023-01-01 00:00:00", F.min("doc_id")).alias("created_at"),
        F.when(n % 2 == 0, at("2023-06-01 00:00:00", n)).alias("last_queried_at"),
    ).withColumnRenamed("source", "name")


def a6_cell_rendering(spark, sf):
    o, e = B.table(spark, sf, "orders"), B.table(spark, sf, "events")
    none = F.lit(None)
    numbers = o.select(F.lit("number").alias("kind"), F.col("o_orderkey").alias("id"), none.cast("string").alias("t"), F.col("o_totalprice").alias("n"), none.cast("timestamp").alias("ts"))
    dates = o.select(F.lit("timestamp").alias("kind"), F.col("o_orderkey").alias("id"), none.cast("string").alias("t"), none.cast("double").alias("n"), F.col("o_orderdate").alias("ts"))
    times = e.select(F.lit("timestamp").alias("kind"), (-F.col("event_id") - 1).alias("id"), none.cast("string").alias("t"), none.cast("double").alias("n"), F.col("ts"))
    labels = e.select(F.lit("text").alias("kind"), F.col("event_id").alias("id"), F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("t"), none.cast("double").alias("n"), none.cast("timestamp").alias("ts"))
    every = numbers.unionByName(dates).unionByName(times).unionByName(labels)
    return every.select("kind", "id", cells.render_cell(F.col("kind"), F.col("t"), F.col("n"), F.col("ts")).alias("value"))


def a7_event_log(spark, sf):
    """The JSON column of the event log, broken lines counted: one event type writes no JSON."""
    e = B.events(spark, sf)
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("oops "), "props")).otherwise(F.col("props"))
    parsed = eventlog.parse_lines(e.select("event_type", line.alias("value")), "k int")
    return parsed.groupBy("event_type").agg(
        F.count_if(~F.col("malformed")).alias("scanned"), F.count_if("malformed").alias("malformed"), F.sum("_e.k").alias("total")
    )


def a7_event_log_round_trip(spark, sf):
    """Append all events as JSON lines to the shared folder, read them back, count by type."""
    from ..session import shared_folder

    folder = shared_folder(spark, "events")
    e = B.events(spark, sf)
    eventlog.append_events(e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("event"), "user_id", "value"), folder)
    back = eventlog.read_events(spark, folder, "timestamp timestamp, event string, user_id long, value double")
    return back.groupBy("event").agg(
        F.count("*").alias("lines"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"),
        F.count_if("malformed").alias("malformed"),
    )


def a8_ledger_csv(spark, sf):
    rows = L.with_matter(B.task_costs(spark, sf), B.matters(spark, sf))
    return sinks.ledger_csv_rows(rows, "America/Toronto")


def k1_matter_list(spark, sf):
    return K.list_matters(doc_matters(spark, sf), B.files(spark, sf)).select(
        "matter_id", "name", "file_count", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss").alias("last_active")
    )


def _delete_events(spark, sf):
    """Purchases delete, signups restore the file numbered by the event value; other events change nothing."""
    return B.events(spark, sf).select(
        F.floor("value").cast("long").alias("file_id"),
        F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "restore").alias("action"),
        F.col("ts").alias("at"), "event_id",
    )


def k2_live_files(spark, sf):
    f = B.files(spark, sf).drop("deleted_at")
    state = K.current_state(f, _delete_events(spark, sf), "file_id")
    return state.select("file_id", F.col("deleted_at").isNull().alias("live"), F.date_format("deleted_at", "yyyy-MM-dd HH:mm:ss").alias("deleted_at"))


def k2_name_check(spark, sf):
    """Customer names wanted again for a new matter."""
    wanted = B.table(spark, sf, "customer").select(F.concat(F.lit(" "), "c_name").alias("wanted"), F.col("c_name").alias("name"))
    return K.name_check(wanted, B.matters(spark, sf)).select("wanted", "state")


def k3_deleted_items(spark, sf):
    out = K.list_deleted_files(B.files(spark, sf), doc_matters(spark, sf), _at(B.AS_OF))
    return out.select("file_id", "filename", "matter_name", "matter_deleted", "days_remaining")


def k4_due_for_purge(spark, sf):
    return K.due_for_purge(B.matters(spark, sf), "matter_id", _at(B.LEDGER_AS_OF), K.PURGE_BATCH).select("matter_id", "name")


def k4_purge_effect(spark, sf):
    """What a purge leaves: files per matter after the cascade."""
    out = K.purge(B.files(spark, sf), doc_matters(spark, sf), _at(B.AS_OF), limit=K.PURGE_BATCH)
    left = out["files"].groupBy("matter_id").agg(F.count("*").alias("files"))
    gone = out["removed_files"].groupBy("matter_id").agg(F.count("*").alias("removed"))
    return left.join(gone, "matter_id", "full").select(
        "matter_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("removed", F.lit(0)).alias("removed")
    )


def k5_date_prefix(spark, sf):
    f = B.files(spark, sf).withColumn("p", K.date_prefix(F.col("filename")))
    return f.select("file_id", F.date_format("p.start", "yyyy-MM-dd").alias("start_date"))


def k5_date_ranges(spark, sf):
    """Orders as file names with a range of dates, a single date, or a range whose end is no date."""
    o = B.table(spark, sf, "orders")
    start, end = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", F.lit(40)), "yyyy_MM_dd")
    joint = F.element_at(F.array(F.lit(" to "), F.lit(" until "), F.lit(" through ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.when(F.col("o_orderstatus") == "F", F.concat(start, joint, end, F.lit(" notes.pdf"))).when(
        F.col("o_orderstatus") == "O", F.concat(start, F.lit(" minutes.pdf"))
    ).otherwise(F.concat(start, joint, F.lit("2024-13-45 plan.pdf")))
    p = K.date_prefix(name)
    return o.select("o_orderkey", F.date_format(p["start"], "yyyy-MM-dd").alias("start_date"), F.date_format(p["end"], "yyyy-MM-dd").alias("end_date"))


def k6_file_order(spark, sf):
    """Position of every file inside its matter in the three orders."""
    f = B.files(spark, sf).select("matter_id", "file_id", "filename", "created_at")
    for order in K.SORT_ORDERS:
        f = K.file_positions(f, order)
    return f.select("matter_id", "file_id", *K.SORT_ORDERS)


def k7_cost_query(spark, sf):
    rows = L.query_costs(
        B.task_costs(spark, sf), B.matters(spark, sf), _at(B.LEDGER_AS_OF), sort="cost", date_from="1996-01-01", date_to="1999-12-31"
    )
    return rows.select("id", "display_matter", "task_id", F.col("cost_usd").cast("double").alias("cost_usd"), F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


def k7_cost_query_last_30_days(spark, sf):
    rows = L.query_costs(B.task_costs(spark, sf), B.matters(spark, sf), _at(B.LEDGER_AS_OF), period="30", sort="matter", direction="asc")
    return rows.select("id", "display_matter", F.col("cost_usd").cast("double").alias("cost_usd"))


def k8_display_names(spark, sf):
    rows = L.with_matter(B.task_costs(spark, sf), B.matters(spark, sf))
    return rows.groupBy("display_matter").agg(F.count("*").alias("n"))


def k9_totals(spark, sf):
    rows = L.with_matter(B.task_costs(spark, sf), B.matters(spark, sf))
    out = L.totals(rows, ["task_id"])
    return out.withColumn("total_cost", F.col("total_cost").cast("double"))


def k10_matter_options(spark, sf):
    return L.matter_options(B.task_costs(spark, sf), B.matters(spark, sf))


def k11_run_costs(spark, sf):
    runs = B.task_costs(spark, sf).select("run_id", "task_id", "matter_id")
    out = L.roll_up_runs(runs, B.calls(spark, sf))
    return out.select("run_id", "task_id", "calls", "input_tokens", "output_tokens", F.col("cost_usd").cast("double").alias("cost_usd"), "model_used")


def k12_backfill(spark, sf):
    """Events of purchases as logged queries; runs already in the ledger are those ordered with urgency."""
    e = B.events(spark, sf)
    logged = e.select(
        F.col("event_id").alias("line_no"), F.col("ts").alias("timestamp"),
        F.when(F.col("event_type").isin("purchase", "view"), "matter_query").otherwise(F.col("event_type")).alias("event"),
        F.when(F.col("event_type") == "view", "timeline").alias("task"),
        F.col("user_id").alias("matter_id"), F.lit("m").alias("model"),
        F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"),
        F.floor("value").alias("cost_usd"), F.col("value").alias("seconds"), F.lit(None).cast("boolean").alias("exhaustive"),
        (F.col("event_type") == "view").alias("cancelled"),
        F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 1000 + F.col("user_id")).cast("string")).alias("run_id"),
    )
    held = B.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("string").alias("run_id"))
    out = L.backfill(logged, held, B.matters(spark, sf))
    return out.select("run_id", "matter_id", "matter_name", "task_id", "input_tokens", "output_tokens", "cost_usd", "status", "source")


def k13_diagnostics(spark, sf):
    """Counts by status and by index state, with names reduced to their structure."""
    f = B.files(spark, sf)
    probed = probe_indexes(f, *_stored_index(spark, sf), dim=64)
    state = f.join(probed.select("file_id", F.col("state").alias("probe")), "file_id", "left")
    return K.diagnostic_counts(K.redacted_files(state))


def _stored_index(spark, sf):
    """Chunks exist for files with a vector; collections are registered for files with labels."""
    f = B.files(spark, sf)
    e = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"), "label", "embedding")
    chunks = f.join(e, "file_id").select(
        "collection", F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding")
    )
    index = chunks.select("collection").unionByName(f.filter(F.col("scanned").isNotNull()).select("collection"))
    return index, chunks


def k13_redacted_manifest(spark, sf):
    f = B.files(spark, sf).withColumn("probe", F.lit(None).cast("string"))
    return K.redacted_files(f).groupBy("ext", "status").agg(F.count("*").alias("files"), F.sum("name_len").alias("name_chars"))


def k14_tier_bounds(spark, sf):
    out = tier_bounds(B.table(spark, sf, "part"), "p_retailprice")
    return out.select(F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def k15_daily_calls(spark, sf):
    out = L.daily_calls(B.events(spark, sf), "ts", ["event_type"], L.KEPT_DAYS)
    return out.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", L.budget_state(F.col("calls"), 60, 70).alias("state"))


def k16_provenance(spark, sf):
    """Orders as results: their lines' suppliers are the chosen files, parts found first the sources."""
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("result_id"), F.lit(4).alias("matter_files"))
    li = B.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("result_id"), F.col("l_suppkey").alias("file_id"), F.col("l_partkey").alias("rank")
    )
    out = K.result_provenance(o, li, li)
    return out.select(
        "result_id", F.array_join("scope_file_ids", ",").alias("scope_file_ids"), F.array_join("source_file_ids", ",").alias("source_file_ids")
    )


def l2_run_states(spark, sf):
    return K.run_states(B.run_events(spark, sf), _at("2024-01-30 23:00:00")).select(
        "run_id", "matter_id", "status", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen")
    )


def l2_silent_gaps(spark, sf):
    """Silences between heartbeats per run, cut where the heartbeats lie so that no run is one task."""
    out = K.silent_gaps(B.run_events(spark, sf))
    return out.groupBy("run_id").agg(F.count("*").alias("gaps"), F.round(F.max("gap_seconds"), 3).alias("longest"))


def l2_grants(spark, sf):
    ev = B.run_events(spark, sf)
    states = K.run_states(ev, _at("2024-01-30 12:00:00"))
    starts = B.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("matter_id"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("at")
    )
    return K.grant_runs(starts, states)


QUERIES = {f.__name__: f for f in (
    a6_cell_rendering, a7_event_log, a7_event_log_round_trip, a8_ledger_csv, k1_matter_list, k2_live_files, k2_name_check,
    k3_deleted_items, k4_due_for_purge, k4_purge_effect, k5_date_prefix, k5_date_ranges, k6_file_order, k7_cost_query,
    k7_cost_query_last_30_days, k8_display_names, k9_totals, k10_matter_options, k11_run_costs, k12_backfill,
    k13_diagnostics, k13_redacted_manifest, k14_tier_bounds, k15_daily_calls, k16_provenance, l2_run_states,
    l2_silent_gaps, l2_grants,
)}

_STATES = """
ev AS (SELECT user_id::VARCHAR AS run_id, user_id % 10 AS matter_id, ts AS moment, event_id,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS status FROM events),
g AS (SELECT run_id, min(matter_id) AS matter_id, min(moment) AS started_at, max(moment) AS last_seen, arg_max(status, (moment, event_id)) AS last,
  arg_min(status, (moment, event_id)) FILTER (status IN ('done', 'failed')) AS ended FROM ev GROUP BY run_id)"""


def _states(as_of: str) -> str:
    return f"""{_STATES},
states AS (SELECT run_id, matter_id, started_at, last_seen, CASE WHEN ended IS NOT NULL THEN ended
  WHEN last IN ('queued', 'running') AND epoch_us(TIMESTAMP '{as_of}') - epoch_us(last_seen) > 120000000 THEN 'interrupted'
  ELSE last END AS status FROM g)"""


SQL = {
    "a6_cell_rendering": """
SELECT 'number' AS kind, o_orderkey AS id, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS value FROM orders
UNION ALL SELECT 'timestamp', o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT 'timestamp', -event_id - 1, CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END FROM events
UNION ALL SELECT 'text', event_id, event_type FROM events""",
    "a7_event_log": """
SELECT event_type, count(*) FILTER (event_type <> 'error') AS scanned, count(*) FILTER (event_type = 'error') AS malformed,
  sum(CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k')::INT END) AS total FROM events GROUP BY event_type""",
    "a7_event_log_round_trip": """
SELECT event_type AS event, count(*) AS lines, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at,
  0 AS malformed FROM events GROUP BY event_type""",
    "a8_ledger_csv": f"""
WITH {_COSTS}
SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp_utc,
  strftime(timestamp - INTERVAL 1 HOUR, '%Y-%m-%d') AS date_local, coalesce(matter_id::VARCHAR, '') AS matter_id,
  display_matter AS matter_name, task_id, model_used AS model, CASE WHEN was_exhaustive THEN 'true' ELSE 'false' END AS exhaustive,
  status, input_tokens::VARCHAR AS input_tokens, output_tokens::VARCHAR AS output_tokens,
  coalesce(round(cost_usd, 4)::DECIMAL(18, 4)::VARCHAR, '') AS cost_usd,
  CASE WHEN duration_seconds IS NULL THEN '' ELSE printf('%.1f', duration_seconds) END AS duration_seconds FROM shown""",
    "k1_matter_list": f"""
WITH {_FILES},{_FILE_MATTERS}
SELECT m.matter_id, m.name, count(f.file_id) AS file_count, strftime(coalesce(last_queried_at, m.created_at), '%Y-%m-%d %H:%M:%S') AS last_active
FROM doc_matters m LEFT JOIN files f ON f.matter_id = m.matter_id AND f.deleted_at IS NULL
WHERE m.deleted_at IS NULL GROUP BY ALL""",
    "k2_live_files": """
WITH e AS (SELECT floor(value)::BIGINT AS file_id, event_type, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup')),
s AS (SELECT file_id, arg_max(event_type, (ts, event_id)) AS t, max(ts) AS moment FROM e GROUP BY file_id)
SELECT doc_id AS file_id, s.t IS NULL OR s.t <> 'purchase' AS live, CASE WHEN s.t = 'purchase' THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS deleted_at
FROM documents d LEFT JOIN s ON s.file_id = d.doc_id""",
    "k2_name_check": f"""
WITH {_MATTERS}
SELECT ' ' || c_name AS wanted, CASE WHEN m.name IS NULL THEN 'free' WHEN m.deleted_at IS NULL THEN 'taken' ELSE 'deleted' END AS state
FROM customer LEFT JOIN matters m ON m.name = c_name""",
    "k3_deleted_items": f"""
WITH {_FILES},{_FILE_MATTERS}
SELECT file_id, filename, name AS matter_name, m.deleted_at IS NOT NULL AS matter_deleted,
  greatest(0, 30 - (epoch_us(TIMESTAMP '{B.AS_OF}') - epoch_us(f.deleted_at)) // 86400000000) AS days_remaining
FROM files f JOIN doc_matters m USING (matter_id) WHERE f.deleted_at IS NOT NULL""",
    "k4_due_for_purge": f"""
WITH {_MATTERS}
SELECT matter_id, name FROM matters WHERE deleted_at < TIMESTAMP '{B.LEDGER_AS_OF}' - INTERVAL 30 DAY ORDER BY deleted_at, matter_id LIMIT 25""",
    "k4_purge_effect": f"""
WITH {_FILES},{_FILE_MATTERS},
gf AS (SELECT file_id FROM files WHERE deleted_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY ORDER BY deleted_at, file_id LIMIT 25),
gm AS (SELECT matter_id FROM doc_matters WHERE deleted_at < TIMESTAMP '{B.AS_OF}' - INTERVAL 30 DAY ORDER BY deleted_at, matter_id LIMIT 25)
SELECT matter_id, count(*) FILTER (NOT gone) AS files, count(*) FILTER (gone) AS removed
FROM (SELECT matter_id, file_id IN (SELECT file_id FROM gf) OR matter_id IN (SELECT matter_id FROM gm) AS gone FROM files) GROUP BY matter_id""",
    "k5_date_prefix": f"""
WITH {_FILES} SELECT file_id, CASE WHEN lang = 'en' THEN substr(filename, 1, 10) END AS start_date FROM files""",
    "k5_date_ranges": """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start_date, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate::DATE + 40, '%Y-%m-%d') END AS end_date FROM orders""",
    "k6_file_order": f"""
WITH {_FILES}, d AS (SELECT *, CASE WHEN lang = 'en' THEN substr(filename, 1, 10) END AS day FROM files)
SELECT matter_id, file_id,
  row_number() OVER (PARTITION BY matter_id ORDER BY day IS NULL, day NULLS LAST, lower(filename), file_id) AS oldest,
  CASE WHEN day IS NOT NULL THEN row_number() OVER (PARTITION BY matter_id, day IS NULL ORDER BY day DESC, lower(filename) DESC, file_id DESC)
    ELSE count(day) OVER (PARTITION BY matter_id) + row_number() OVER (PARTITION BY matter_id, day IS NULL ORDER BY lower(filename), file_id) END AS newest,
  row_number() OVER (PARTITION BY matter_id ORDER BY created_at, file_id) AS upload FROM d""",
    "k7_cost_query": f"""
WITH {_COSTS}
SELECT id, display_matter, task_id, cost_usd::DOUBLE AS cost_usd, strftime(timestamp, '%Y-%m-%d') AS day FROM shown
WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '2000-01-01'""",
    "k7_cost_query_last_30_days": f"""
WITH {_COSTS}
SELECT id, display_matter, cost_usd::DOUBLE AS cost_usd FROM shown WHERE timestamp >= TIMESTAMP '{B.LEDGER_AS_OF}' - INTERVAL 30 DAY""",
    "k8_display_names": f"WITH {_COSTS} SELECT display_matter, count(*) AS n FROM shown GROUP BY 1",
    "k9_totals": f"""
WITH {_COSTS}
SELECT task_id, round(sum(coalesce(cost_usd, 0)), 4)::DOUBLE AS total_cost, count(*) AS rows, count(*) FILTER (cost_usd IS NULL) AS unknown_cost
FROM shown GROUP BY task_id""",
    "k10_matter_options": f"""
WITH {_COSTS},
g AS (SELECT matter_id, max(matter_name) AS matter_name, count(*) AS n FROM costs WHERE matter_id IS NOT NULL GROUP BY matter_id)
SELECT g.matter_id, n, CASE WHEN m.name IS NOT NULL THEN m.name || CASE WHEN m.deleted_at IS NOT NULL THEN ' (deleted)' ELSE '' END
  WHEN matter_name IS NOT NULL THEN matter_name || ' (removed)' ELSE 'Matter ' || g.matter_id || ' (removed)' END AS label
FROM g LEFT JOIN matters m ON m.matter_id = g.matter_id""",
    "k11_run_costs": """
WITH c AS (SELECT l_orderkey AS k, count(*) AS calls, sum(l_quantity::BIGINT) AS i, sum(floor(l_extendedprice)::BIGINT) AS o,
  CASE WHEN count(*) = count(*) FILTER (l_discount > 0) THEN sum(l_extendedprice::DECIMAL(18, 2)) END AS cost,
  arg_min('model-' || lower(l_returnflag), (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS model FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS run_id, lower(o_orderpriority) AS task_id, coalesce(calls, 0) AS calls, coalesce(i, 0) AS input_tokens,
  coalesce(o, 0) AS output_tokens, CASE WHEN calls IS NULL THEN 0 ELSE cost END::DOUBLE AS cost_usd, model AS model_used
FROM orders LEFT JOIN c ON k = o_orderkey""",
    "k12_backfill": f"""
WITH {_MATTERS},
e AS (SELECT event_id, event_type, user_id, floor(value)::BIGINT AS cost, json_extract_string(props, '$.k')::BIGINT AS p,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 1000 + user_id)::VARCHAR END AS run_id FROM events WHERE event_type IN ('purchase', 'view') AND floor(value) <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM e
  WHERE run_id IS NULL OR run_id NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT run_id, user_id AS matter_id, m.name AS matter_name, CASE WHEN event_type = 'view' THEN 'timeline' ELSE 'unknown' END AS task_id,
  coalesce(p, 0) AS input_tokens, 0 AS output_tokens, cost AS cost_usd, CASE WHEN event_type = 'view' THEN 'cancelled' ELSE 'completed' END AS status,
  'backfill' AS source FROM f LEFT JOIN matters m ON m.matter_id = user_id WHERE run_id IS NULL OR n = 1""",
    "k13_diagnostics": f"""
WITH {_FILES},
held AS (SELECT f.collection, count(*) AS n, count(*) FILTER (label = 3) AS bad FROM files f JOIN embeddings e ON e.vec_id = f.file_id GROUP BY 1),
known AS (SELECT collection FROM held UNION SELECT collection FROM files WHERE scanned IS NOT NULL),
s AS (SELECT f.*, CASE WHEN ingest_status = 'failed_no_text' THEN NULL WHEN f.collection NOT IN (SELECT collection FROM known) THEN 'missing'
  WHEN n IS NULL THEN 'empty' WHEN bad > 0 THEN 'unreadable' ELSE 'ok' END AS probe FROM files f LEFT JOIN held USING (collection))
SELECT 'status' AS kind, ingest_status AS value, count(*) AS files FROM s GROUP BY 2
UNION ALL SELECT 'probe', probe, count(*) FROM s WHERE probe IS NOT NULL GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM s""",
    "k13_redacted_manifest": f"""
WITH {_FILES}
SELECT CASE WHEN lang = 'en' THEN '.pdf' ELSE '.docx' END AS ext, ingest_status AS status, count(*) AS files, sum(length(filename)) AS name_chars
FROM files GROUP BY 1, 2""",
    "k14_tier_bounds": "SELECT round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.9), 6) AS p90 FROM part",
    "k15_daily_calls": """
WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM events GROUP BY 1, 2)
SELECT event_type, day, calls, CASE WHEN calls >= 70 THEN 'stop' WHEN calls >= 60 THEN 'warn' ELSE 'ok' END AS state FROM d
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 30""",
    "k16_provenance": """
WITH f AS (SELECT l_orderkey AS k, l_suppkey AS s, min(l_partkey) AS r FROM lineitem GROUP BY 1, 2),
g AS (SELECT k, count(*) AS n, string_agg(s::VARCHAR, ',' ORDER BY s) AS scope, string_agg(s::VARCHAR, ',' ORDER BY r, s) AS used FROM f GROUP BY k)
SELECT o_orderkey AS result_id, CASE WHEN n < 4 THEN scope END AS scope_file_ids, coalesce(used, '') AS source_file_ids
FROM orders LEFT JOIN g ON k = o_orderkey""",
    "l2_run_states": f"""
WITH {_states('2024-01-30 23:00:00')}
SELECT run_id, matter_id, status, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM states""",
    "l2_silent_gaps": """
WITH g AS (SELECT user_id::VARCHAR AS run_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
SELECT run_id, count(*) AS gaps, round(max(gap), 3) AS longest FROM g WHERE gap > 120 GROUP BY run_id""",
    "l2_grants": f"""
WITH {_states('2024-01-30 12:00:00')},
a AS (SELECT matter_id, arg_min(run_id, (started_at, run_id)) AS holder FROM states WHERE status IN ('queued', 'running') GROUP BY 1),
s AS (SELECT o_custkey % 10 AS matter_id, 'n' || o_orderkey AS run_id, o_orderdate AS moment FROM orders),
f AS (SELECT matter_id, arg_min(run_id, (moment, run_id)) AS first FROM s GROUP BY 1)
SELECT s.matter_id, s.run_id, coalesce(holder, first) AS holder, coalesce(holder, first) = s.run_id AS granted
FROM s JOIN f USING (matter_id) LEFT JOIN a USING (matter_id)""",
}
