"""Run a registered query on Spark and its SQL on DuckDB and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def check(spark, con, sf, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            print("plan holds", bad, flush=True)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    rel = con.execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    t2 = time.time()
    return got, want, t1 - t0, t2 - t1


def explain_difference(got, want) -> str:
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} / {len(want[1])}; only ours {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(got[1])} rows differ, e.g.\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}" if bad else ""


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from casefile_spark.session import get_session

    sf = "/root/testdata/sf0.01"
    args = [a for a in sys.argv[1:]]
    if args and args[0].startswith("sf="):
        sf = args.pop(0)[3:]
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            if name not in sqls:
                t0 = time.time()
                df = fn(spark, sf)
                n = len(df.collect())
                print(f"rows {name} {n} rows {time.time() - t0:.1f}s", flush=True)
                continue
            got, want, a, b = check(spark, con, sf, fn, sqls[name])
            why = explain_difference(got, want)
            failed += bool(why)
            print(f"{'FAIL' if why else 'ok  '} {name} {len(got[1])} rows spark {a:.1f}s duck {b:.1f}s {why}", flush=True)
        except Exception as e:  # report and go on
            failed += 1
            print(f"ERR  {name} {type(e).__name__}: {str(e)[:1500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
