"""Seconds per headline query.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
Every query runs from its files to the end of its result, twice; ``queries`` holds the second (warm JVM) run and
``cold`` the first.  No cached or staged table is kept between runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.plans import catalog  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = (
    "bars_daily", "cl_audit", "ind_rsi", "ind_macd", "ind_adx", "events_bollinger", "risk_snapshot", "risk_metrics", "risk_hurst",
    "pa_correlation_covariance", "bt_run_classic", "bt_walk_forward", "bt_portfolio_curve", "ph_value_series", "fa_scorecard",
    "sc_run_screen", "sc_sector_percentiles", "mc_bootstrap", "ml_dataset", "ns_score_text", "al_evaluate_all", "stream_bars_hourly",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in HEADLINE:
        for kept in (cold, warm):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            kept[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline queries, total (warm)", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
