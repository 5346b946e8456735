"""Cost ledger: roll-up from calls, queries, totals, backfill and daily budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sortable columns, periods, daily call limits.
SORT_COLUMNS = {"timestamp": "timestamp", "matter": "matter_name", "task": "task_id", "model": "model_used", "cost": "cost_usd"}
PERIOD_DAYS = {"7": 7, "30": 30}
DAILY_LIMIT, DAILY_WARN, DAILY_STOP = 5000, 4000, 4900
KEPT_DAYS = 30
BUDGET_WARNING = (
    "%s of CanLII's 5,000 daily API calls have been used on this machine. "
    "Case discovery stops at 4,900 and resets at midnight UTC."
)


def display_matter() -> Column:
    """How a matter reads in the log, whatever became of it."""
    live, stored = F.coalesce("live_name", F.lit("")), F.coalesce("matter_name", F.lit(""))
    return (
        F.when(F.col("matter_id").isNull(), "(no matter)")
        .when((live != "") & F.col("matter_deleted_at").isNotNull(), F.concat(live, F.lit(" (deleted)")))
        .when(live != "", live)
        .when(stored != "", F.concat(stored, F.lit(" (removed)")))
        .otherwise(F.concat(F.lit("Matter "), F.col("matter_id").cast("string"), F.lit(" (removed)")))
    )


def with_matter(costs: DataFrame, matters: DataFrame) -> DataFrame:
    """Left join that keeps soft-deleted matters: the money was spent either way."""
    names = matters.select("matter_id", F.col("name").alias("live_name"), F.col("deleted_at").alias("matter_deleted_at"))
    return costs.join(names, "matter_id", "left").withColumn("display_matter", display_matter())


def query_costs(
    costs: DataFrame,
    matters: DataFrame,
    as_of: Column,
    matter_id: int | None = None,
    period: str = "30",
    sort: str = "timestamp",
    direction: str = "desc",
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Ledger rows by matter, period or half-open date range, in an allow-listed order."""
    at = F.col("timestamp")
    rows = costs
    if matter_id is not None:
        rows = rows.filter(F.col("matter_id") == matter_id)
    if date_from:
        rows = rows.filter(at >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.filter(at < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
    if not date_from and not date_to and period in PERIOD_DAYS:
        rows = rows.filter(at >= as_of - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAYS"))
    key = F.col(SORT_COLUMNS.get(sort, "timestamp"))
    ordered = key.asc_nulls_first() if direction == "asc" else key.desc_nulls_last()
    return with_matter(rows, matters).orderBy(ordered, "id")


def totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total cost (unknown counts as 0), row count, unknown count."""
    return rows.groupBy(*(by or [])).agg(
        F.round(F.sum(F.coalesce("cost_usd", F.lit(0))), 4).alias("total_cost"),
        F.count("*").alias("rows"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost"),
    )


def matter_options(costs: DataFrame, matters: DataFrame) -> DataFrame:
    """Matters that appear in the ledger with their label and row count, by name."""
    counts = costs.filter(F.col("matter_id").isNotNull()).groupBy("matter_id").agg(
        F.max("matter_name").alias("matter_name"), F.count("*").alias("n")
    )
    return (
        with_matter(counts, matters)
        .select("matter_id", F.col("display_matter").alias("label"), "n", F.coalesce("live_name", "matter_name").alias("_o"))
        .orderBy("_o", "matter_id")
        .drop("_o")
    )


def roll_up_runs(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Ledger measures per run. One call without a cost leaves the run's cost unknown.

    runs: run_id, ...; calls: run_id, seq, model, input_tokens, output_tokens, cost_usd. Runs
    without calls keep a row with zero cost.
    """
    per_run = calls.groupBy("run_id").agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.when(F.count("cost_usd") == F.count("*"), F.sum("cost_usd")).alias("_cost"),
        F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("seq"))).alias("model_used"),
    )
    cost = F.when(F.col("calls").isNull(), F.lit(0)).otherwise(F.round("_cost", 6))
    joined = runs.join(per_run, "run_id", "left")
    return joined.withColumn("cost_usd", cost).drop("_cost").na.fill(0, ["calls", "input_tokens", "output_tokens"])


def backfill(events: DataFrame, ledger: DataFrame, matters: DataFrame) -> DataFrame:
    """Ledger rows for cost-bearing events not recorded yet, tagged as reconstructed.

    events: line_no, timestamp, event, task, matter_id, model, prompt_tokens, completion_tokens,
    cost_usd, seconds, exhaustive, cancelled, run_id. Of several events of one run the first counts;
    events without a run id always count. Running it again adds nothing for runs with an id.
    """
    bearing = events.filter((F.col("event") == "matter_query") & (F.coalesce("cost_usd", F.lit(0)) != 0))
    known = ledger.select("run_id").filter(F.col("run_id").isNotNull()).distinct()
    fresh = bearing.join(known, "run_id", "left_anti")
    with_id = fresh.filter(F.col("run_id").isNotNull())
    first = with_id.groupBy("run_id").agg(F.min("line_no").alias("line_no"))
    kept = with_id.join(first, ["run_id", "line_no"], "left_semi").unionByName(fresh.filter(F.col("run_id").isNull()))
    names = matters.select("matter_id", F.col("name").alias("matter_name"))
    return kept.join(names, "matter_id", "left").select(
        "timestamp", "matter_id", "matter_name", F.coalesce("task", F.lit("unknown")).alias("task_id"),
        F.col("model").alias("model_used"),
        F.coalesce("prompt_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).alias("output_tokens"),
        "cost_usd", F.col("seconds").alias("duration_seconds"),
        F.coalesce("exhaustive", F.lit(False)).alias("was_exhaustive"),
        F.when(F.coalesce("cancelled", F.lit(False)), "cancelled").otherwise("completed").alias("status"),
        F.lit("backfill").alias("source"), "run_id",
    )


def backfill_counts(events: DataFrame, inserted: DataFrame) -> DataFrame:
    """scanned, inserted, skipped: cost-bearing events that were zero or already recorded."""
    bearing = ((F.col("event") == "matter_query") & F.col("has_cost")).cast("int")
    seen = events.select(F.lit(1).alias("s"), F.coalesce(bearing, F.lit(0)).alias("b"), F.lit(0).alias("i"))
    added = inserted.select(F.lit(0).alias("s"), F.lit(0).alias("b"), F.lit(1).alias("i"))
    return seen.unionByName(added).agg(
        F.sum("s").alias("scanned"), F.sum("i").alias("inserted"), (F.sum("b") - F.sum("i")).alias("skipped")
    )


def daily_calls(calls: DataFrame, at: str, keys: list[str] | None = None, days: int | None = None) -> DataFrame:
    """Calls per UTC day with the budget state; with ``days``, the last so many that saw any."""
    keys = keys or []
    per_day = calls.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("calls"))
    if days is not None:
        newest = Window.partitionBy(*keys).orderBy(F.desc("day"))
        per_day = per_day.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= days).drop("_n")
    return per_day.withColumn("state", budget_state(F.col("calls")))


def budget_state(calls: Column, warn: int = DAILY_WARN, stop: int = DAILY_STOP) -> Column:
    return F.when(calls >= stop, "stop").when(calls >= warn, "warn").otherwise("ok")


def budget_warning(calls: Column) -> Column:
    return F.when(calls >= DAILY_WARN, F.format_string(BUDGET_WARNING, F.format_number(calls, 0)))
