"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names, to time others
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bar_scan", "mom_risk_adj", "low_idio_vol", "build_family", "information_coefficient", "ic_decay_curve", "quantile_returns",
    "combine_adaptive", "build_weights_zscore_riskparity", "simulate", "grid_study", "covariance_constant_correlation",
    "detect_bad_tick_core", "clean_tick_stream", "dollar_volume_bars", "batch_features", "cusum_events", "triple_barrier_labels",
    "purged_kfold", "resolve_trade_params", "kelly_bins", "order_lifecycle_audit", "stream_cusum_triggers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from barloom.plans import load_all
    from barloom.session import local_session

    spark = local_session(cpus, "bench", spark__sql__shuffle__partitions=str(max(8, int(cpus) if cpus.isdigit() else 8)))
    queries = load_all()
    queries[names[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM and page-cache warm-up
    times: dict[str, float] = {}
    for n in names:
        t = time.time()
        queries[n].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
