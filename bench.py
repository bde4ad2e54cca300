"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed from building its plan to having written every row (the noop sink), after one warm-up of
the session. ``rows_per_sec`` counts each query's own input rows.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "resample_ohlcv",
    "fill_time_gaps",
    "interpolate_linear",
    "fix_outliers_median",
    "clean_standard",
    "health_report",
    "series_stats",
    "rsi_14",
    "macd_hist",
    "adx_14",
    "vwap",
    "base_features",
    "feature_matrix",
    "realtime_features",
    "sequences",
    "scale_robust",
    "match_fifo",
    "equity_curve",
    "performance",
    "log_metrics",
    "error_spikes",
    "parse_json_logs",
    "auc_by_class",
    "knn_impute",
    "stream_bars",
]

#: What a query's rows per second count: bars (half hours of the events), or the rows of a table.
INPUT = {
    **dict.fromkeys(("resample_ohlcv", "match_fifo", "log_metrics", "error_spikes", "parse_json_logs", "stream_bars"), "events"),
    **dict.fromkeys(("equity_curve", "performance"), "orders"),
}


def main() -> None:
    from tidemark.catalog import QUERIES
    from tidemark.session import local_session

    spark = local_session(CPUS, "bench")
    QUERIES["rsi_14"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("events", "orders")}
    rows["bars"] = QUERIES["resample_ohlcv"](spark, SF_DIR).count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "input_rows": rows,
        "rows_per_sec": {name: round(rows[INPUT.get(name, "bars")] / s) for name, s in seconds.items()},
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
