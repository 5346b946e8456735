"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from casefile_spark.plans import registry  # noqa: E402
from casefile_spark.session import get_session  # noqa: E402

HEADLINE = (
    "d3_scatter_gather_top_k", "d4_top_k_per_file", "b1_token_windows", "b15_chunk_ids", "j1_lexicon_scan", "g6_collapse_lines",
    "k7_cost_query", "k11_run_costs", "k15_daily_calls", "e2_batches", "b8_event_runs", "i2_search", "i10_shortlist",
    "h1_extract_citations", "h5_verify", "c2_extraction_verdict", "c4_first_copies", "g2_timeline_rows", "f3_context_message", "l2_run_states",
    "b9_section_chunks", "l1_ingest_stream",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()
    times = {}
    for name in wanted:
        started = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
