"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and $BENCH_RUNS times (default 2) for the median; results are consumed by a noop write.
$BENCH_ONLY takes a comma-separated list of query names, or "all"."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescope.registry import all_entries
from tablescope.session import local_session

HEADLINE = (
    "column_overview", "duplicate_row_count", "describe_all", "id_like_columns", "numeric_describe", "quantiles", "shape_flags", "histogram",
    "boxplot_stats", "value_counts", "cardinality", "missing_heatmap", "counts_by_month", "gap_stats", "rolling_mean_30d", "rolling_mean_by_key",
    "time_trend", "autocorrelation", "corr_matrix", "spearman_matrix", "group_describe", "group_agg", "mann_whitney", "kruskal_wallis",
    "outlier_ranking", "zscore_row_flags", "isolation_forest", "frequency_encode", "bin_quantile", "aggregate_by", "top_k", "column_summary",
    "context_pack", "log_running_totals", "clean_markdown", "split_report_lines",
)


def seconds(query, spark, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    entries = all_entries()
    names = list(entries) if only == "all" else only.split(",") if only else HEADLINE
    spark = local_session(cpus)
    times = {}
    for name in names:
        query = entries[name][0]
        seconds(query, spark, sf)
        times[name] = round(statistics.median(seconds(query, spark, sf) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries (warm, median)", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
