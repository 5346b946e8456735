"""Casefile registry: live views over append-only state, deletion window, file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import Running, positions, ranged, running, segmented

# Recovery window, purge batch, two-digit year pivot, date-prefix patterns, orders.
RECOVERY_DAYS = 30
PURGE_BATCH = 25
YEAR_PIVOT = 70
DATE_PREFIX = r"^(\d{4}|\d{2})[-_.](\d{1,2})[-_.](\d{1,2})(.*)$"
RANGE_JOIN = r"(?i)^\s*(?:to|-|until|through)\s*"
SORT_ORDERS = ("oldest", "newest", "upload")


# --- live views ------------------------------------------------------------------------------
def current_state(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows with the newest deleted_at of their delete and restore events.

    events: <key>, action (delete, restore, or NULL for what changes nothing), at, event_id.
    """
    newest = F.max_by(F.struct("action", "at"), F.struct("at", "event_id"))
    last = events.filter(F.col("action").isNotNull()).groupBy(key).agg(newest.alias("_e"))
    gone = F.when(F.col("_e.action") == "delete", F.col("_e.at"))
    return rows.join(last, key, "left").withColumn("deleted_at", gone).drop("_e")


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("deleted_at").isNull())


def name_check(wanted: DataFrame, matters: DataFrame) -> DataFrame:
    """free, taken, or deleted (refused until restored or purged) per wanted matter name."""
    held = matters.groupBy(F.trim("name").alias("_n")).agg(
        F.count_if(F.col("deleted_at").isNull()).alias("_live"), F.count("*").alias("_all")
    )
    state = F.when(F.col("_live") > 0, "taken").when(F.col("_all") > 0, "deleted").otherwise("free")
    return wanted.join(held, F.trim(wanted["name"]) == F.col("_n"), "left").withColumn("state", state).drop("_n", "_live", "_all")


def list_matters(matters: DataFrame, files: DataFrame, deleted: bool = False) -> DataFrame:
    """Matters with their number of live files, the most recently active (or deleted) first."""
    counts = live(files).groupBy("matter_id").agg(F.count("*").alias("file_count"))
    chosen = matters.filter(F.col("deleted_at").isNotNull() if deleted else F.col("deleted_at").isNull())
    latest = F.col("deleted_at") if deleted else F.coalesce("last_queried_at", "created_at")
    return (
        chosen.join(counts, "matter_id", "left")
        .withColumn("file_count", F.coalesce("file_count", F.lit(0)))
        .withColumn("last_active", latest)
        .orderBy(F.desc("last_active"), "matter_id")
    )


def days_remaining(deleted_at: Column, as_of: Column) -> Column:
    """Whole days left in the recovery window; the full window for a live row."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(deleted_at)) / F.lit(86_400_000_000))
    return F.when(deleted_at.isNull(), RECOVERY_DAYS).otherwise(F.greatest(F.lit(0), RECOVERY_DAYS - age)).cast("int")


def list_deleted_files(files: DataFrame, matters: DataFrame, as_of: Column) -> DataFrame:
    owner = matters.select("matter_id", F.col("name").alias("matter_name"), F.col("deleted_at").isNotNull().alias("matter_deleted"))
    return (
        files.filter(F.col("deleted_at").isNotNull()).join(owner, "matter_id")
        .withColumn("days_remaining", days_remaining(F.col("deleted_at"), as_of))
        .orderBy(F.desc("deleted_at"), "file_id")
    )


# --- purge -----------------------------------------------------------------------------------
def due_for_purge(rows: DataFrame, key: str, as_of: Column, limit: int | None = None) -> DataFrame:
    """Rows whose recovery window has passed; with ``limit``, the oldest so many."""
    cutoff = as_of - F.expr(f"INTERVAL {RECOVERY_DAYS} DAYS")
    due = rows.filter(F.col("deleted_at") < cutoff)
    return due if limit is None else due.orderBy("deleted_at", key).limit(limit)


def purge(files: DataFrame, matters: DataFrame, as_of: Column, store_available: bool = True, limit: int | None = None) -> dict[str, DataFrame]:
    """What one purge run removes and leaves. Nothing goes while the chunk index is unavailable.

    Returns removed_files (to drop from the index), files, matters and the audit events.
    """
    up = F.lit(store_available)
    gone_files = due_for_purge(files, "file_id", as_of, limit).filter(up)
    gone_matters = due_for_purge(matters, "matter_id", as_of, limit).filter(up)
    cascade = files.join(gone_matters.select("matter_id"), "matter_id", "left_semi")
    removed = gone_files.select("matter_id", "file_id").unionByName(cascade.select("matter_id", "file_id")).distinct()

    def event(rows: DataFrame, kind: str, name: str) -> DataFrame:
        return rows.select(
            F.lit("permanent_delete").alias("event"), F.lit(kind).alias("kind"), F.col(name).alias("name"),
            F.col("matter_id"), F.lit(RECOVERY_DAYS).alias("after_days"),
        )

    return {
        "removed_files": removed,
        "files": files.join(removed, ["matter_id", "file_id"], "left_anti"),
        "matters": matters.join(gone_matters.select("matter_id"), "matter_id", "left_anti"),
        "events": event(gone_files, "file", "filename").unionByName(event(gone_matters, "matter", "name")),
    }


# --- file names and order --------------------------------------------------------------------
def _calendar_date(y: Column, m: Column, d: Column) -> Column:
    n = y.try_cast("int")
    year = F.when(F.length(y) == 2, n + F.when(n < YEAR_PIVOT, 2000).otherwise(1900)).otherwise(n)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _leading_date(text: Column) -> tuple[Column, Column]:
    def part(i: int) -> Column:
        return F.regexp_extract(text, DATE_PREFIX, i)

    rest = part(4)
    bounded = rest.rlike(r"^([\s\-_.]|$)")
    return F.when(text.rlike(DATE_PREFIX) & bounded, _calendar_date(part(1), part(2), part(3))), rest


def date_prefix(filename: Column) -> Column:
    """struct(start, end) of a leading date or date range in a file name; NULL when there is none."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    start, rest = _leading_date(stem)
    end, _ = _leading_date(F.regexp_replace(rest, RANGE_JOIN, ""))
    end = F.when(rest.rlike(RANGE_JOIN), end)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def sort_keys(filename: Column, file_id: Column, uploaded: Column, order: str) -> list[Column]:
    """Sort columns: dated files first, undated by name; newest-first turns only the dated group."""
    order = order if order in SORT_ORDERS else "oldest"
    if order == "upload":
        return [uploaded.asc(), file_id.asc()]
    start = date_prefix(filename)["start"]
    name = F.lower(F.coalesce(filename, F.lit("")))
    dated = start.isNotNull()
    if order == "oldest":
        return [(~dated).asc(), start.asc_nulls_last(), name.asc(), file_id.asc()]
    when_dated = F.when(dated, name)
    when_undated = F.when(~dated, name)
    turned = F.when(dated, file_id)
    return [
        (~dated).asc(), start.desc_nulls_last(), when_dated.desc_nulls_last(), turned.desc_nulls_last(),
        when_undated.asc_nulls_first(), file_id.asc(),
    ]


def file_positions(files: DataFrame, order: str = "oldest") -> DataFrame:
    """``order``: each file's number within its matter, from 1; a matter with most files is cut into ranges like all others."""
    return positions(files, ["matter_id"], sort_keys(F.col("filename"), F.col("file_id"), F.col("created_at"), order), order)


def sort_files(files: DataFrame, order: str = "oldest") -> DataFrame:
    return files.orderBy(*sort_keys(F.col("filename"), F.col("file_id"), F.col("created_at"), order))


# --- runs of a matter ------------------------------------------------------------------------
# Seconds without a heartbeat after which a run counts as dead, run states.
STALE_SECONDS = 120
ACTIVE = ("queued", "running")
TERMINAL = ("done", "failed", "cancelled", "interrupted")
INTERRUPTED = "The application closed while this analysis was running, so it did not finish. Run it again."


def run_states(events: DataFrame, as_of: Column) -> DataFrame:
    """Newest state per run; active runs without a heartbeat in time read as interrupted.

    events: run_id, matter_id, status, at, event_id. The first terminal state of a run wins.
    """
    terminal = F.col("status").isin(*TERMINAL)
    at = F.struct("at", "event_id")
    per_run = events.groupBy("run_id").agg(
        F.first("matter_id", ignorenulls=True).alias("matter_id"),
        F.min("at").alias("started_at"),
        F.max("at").alias("last_seen"),
        F.max_by("status", at).alias("_last"),
        F.min_by("status", F.when(terminal, at)).alias("_end"),
    )
    quiet = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 1e6 > STALE_SECONDS
    status = (
        F.when(F.col("_end").isNotNull(), F.col("_end"))
        .when(F.col("_last").isin(*ACTIVE) & quiet, "interrupted")
        .otherwise(F.col("_last"))
    )
    return per_run.withColumn("status", status).withColumn(
        "error", F.when(F.col("_end").isNull() & (F.col("status") == "interrupted"), INTERRUPTED)
    ).drop("_last", "_end")


def silent_gaps(events: DataFrame) -> DataFrame:
    """Rows that follow a silence longer than the limit: the run was dead in between."""
    events = ranged(events, ["run_id"], ["at", "event_id"]).drop("_at")
    seen = running(segmented(events, ["run_id"], F.col("_seg")), ["run_id"], ["at", "event_id"], None, Running("previous", F.col("at"), "previous_at")).drop("_seg")
    gap = (F.unix_micros("at") - F.unix_micros("previous_at")) / 1e6
    return seen.withColumn("gap_seconds", gap).filter(gap > STALE_SECONDS)


def grant_runs(starts: DataFrame, states: DataFrame) -> DataFrame:
    """One active run per matter: a start while another run is active is given that run's id.

    starts: matter_id, run_id, at. Among new starts of a matter the first one gets the matter.
    """
    active = states.filter(F.col("status").isin(*ACTIVE)).groupBy("matter_id").agg(
        F.min_by("run_id", F.struct("started_at", "run_id")).alias("_holder")
    )
    first = starts.groupBy("matter_id").agg(F.min_by("run_id", F.struct("at", "run_id")).alias("_first"))
    holder = F.coalesce("_holder", "_first")
    return starts.join(first, "matter_id").join(active, "matter_id", "left").select(
        "matter_id", "run_id", holder.alias("holder"), (holder == F.col("run_id")).alias("granted")
    )


# --- diagnostics and provenance --------------------------------------------------------------
def redacted_files(files: DataFrame) -> DataFrame:
    """Structure only: extension and name length instead of the name."""
    name = F.coalesce("filename", F.lit(""))
    return files.select(
        "matter_id", "file_id", F.lower(F.regexp_extract(name, r"[^.](\.[^./\\]+)$", 1)).alias("ext"),
        F.length(name).alias("name_len"), F.col("ingest_status").alias("status"),
        (F.coalesce("collection", F.lit("")) != "").alias("has_collection"), "probe",
    )


def diagnostic_counts(redacted: DataFrame) -> DataFrame:
    """Files by status and by index state in one pass."""
    grouped = redacted.groupingSets(
        [["status"], ["probe"], []], "status", "probe"
    ).agg(F.grouping_id().alias("_g"), F.count("*").alias("files"))
    kind = F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "probe").otherwise("all")
    value = F.coalesce(F.when(F.col("_g") == 1, F.col("status")).when(F.col("_g") == 2, F.col("probe")), F.lit(""))
    return grouped.select(kind.alias("kind"), value.alias("value"), "files").filter(
        (F.col("kind") == "all") | (F.col("value") != "")
    )


def result_provenance(results: DataFrame, scope: DataFrame, hits: DataFrame) -> DataFrame:
    """Chosen files next to contributing files; the choice is recorded only when it narrowed the matter.

    results: result_id, matter_files. scope: result_id, file_id. hits: result_id, file_id, rank.
    """
    chosen = scope.groupBy("result_id").agg(F.array_sort(F.collect_set("file_id")).alias("_scope"))
    first = hits.groupBy("result_id", "file_id").agg(F.min("rank").alias("_r"))
    used = first.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("_r", "file_id"))).alias("_used"))
    narrowed = F.size("_scope") < F.col("matter_files")
    return results.join(chosen, "result_id", "left").join(used, "result_id", "left").select(
        "result_id",
        F.when(narrowed, F.col("_scope")).alias("scope_file_ids"),
        F.transform(F.coalesce("_used", F.array()), lambda s: s["file_id"]).alias("source_file_ids"),
    )
