"""Numbers, runs and silences of a key that holds all rows, and exact quantiles, against plain versions."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from casefile_spark.functions import selection
from casefile_spark.functions.segments import islands, positions, ranged
from casefile_spark.operators import registry as K


def test_one_key_with_all_rows_is_many_ranges(spark):
    rows = spark.range(5000).select(F.lit(1).alias("k"), F.lit("2024-01-01").alias("day"), F.col("id"))
    held = ranged(rows, ["k"], ["day", "id"], rows=250)
    per_range = [r["count"] for r in held.groupBy("_seg").count().collect()]
    assert len(per_range) > 15 and max(per_range) < 1500
    got = positions(rows, ["k"], ["day", F.desc("id")], "n", rows=250).collect()
    assert all(r.n == 5000 - r.id for r in got) and len(got) == 5000


def test_numbers_within_keys_with_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "", "a", *["hot"] * 5]), rng.choice([None, *range(40)]), i) for i in range(800)]
    got = positions(spark.createDataFrame(rows, "k string, v int, id int"), ["k"], [F.asc_nulls_first("v"), "id"], "n", rows=100).collect()
    want = {}
    for k in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(ordered)}
    assert {r.id: r.n for r in got} == want
    assert positions(spark.createDataFrame([], "k string, id int"), ["k"], ["id"], "n").collect() == []


@pytest.mark.parametrize("order", K.SORT_ORDERS)
def test_one_matter_with_all_files(spark, order):
    day = dt.datetime(2024, 1, 1)
    rng = random.Random(2)
    files = [(7, i, rng.choice([f"2024-{rng.randint(1, 12):02}-03 note.pdf", f"letter {rng.randint(0, 30)}.pdf"]), day) for i in range(300)]
    df = spark.createDataFrame(files, "matter_id long, file_id long, filename string, created_at timestamp")
    want = [r.file_id for r in K.sort_files(df, order).collect()]
    assert [r.file_id for r in sorted(K.file_positions(df, order).collect(), key=lambda r: r[order])] == want


def test_one_run_within_one_day(spark):
    """All rows share run and day; the cut must come from the rows themselves."""
    rng, at, rows = random.Random(3), dt.datetime(2024, 1, 1), []
    for i in range(2000):
        at += dt.timedelta(seconds=rng.choice([5, 5, 5, 150]))
        rows.append(("r", 1, "running", at, i, rng.choice("ab")))
    df = spark.createDataFrame(rows, "run_id string, matter_id long, status string, at timestamp, event_id long, kind string")
    assert K.silent_gaps(df).count() == sum((b[3] - a[3]).total_seconds() > 120 for a, b in zip(rows, rows[1:]))
    held = ranged(df, ["run_id"], ["at", "event_id"], rows=100).withColumnRenamed("_seg", "_range")
    got = islands(held, ["run_id"], ["at", "event_id"], F.col("_range"), ["kind"], "n").select("event_id", "n").collect()
    n, want = 0, {}
    for before, row in zip([None, *rows], rows):
        n += before is None or before[5] != row[5]
        want[row[4]] = n
    assert {r.event_id: r.n for r in got} == want


@pytest.mark.parametrize("values", [[1.5], [1.0, 2.0], [3.0] * 50, [None, float("nan"), 4.0, 5.0, 9.0], [1e-300, 1.0, 1e300, -1e308, 1.7e308, 0.0, -0.0] * 3, []])
def test_quantiles_of_few_values(spark, values):
    got = selection.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", low=0.0, half=0.5, high=1.0).first()
    real = sorted(v for v in values if v is not None and v == v)
    assert tuple(got) == ((real[0], statistics.median(real), real[-1]) if real else (None, None, None))


def test_quantiles_equal_the_buffered_ones(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice([rng.lognormvariate(0, 3), float(rng.randint(0, 9))]),) for _ in range(20_000)], "v double")
    got = selection.quantiles(df, "v", a=0.01, b=0.5, c=0.9, d=0.999).first()
    want = df.agg(*[F.percentile("v", F.lit(p)) for p in (0.01, 0.5, 0.9, 0.999)]).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-12)
