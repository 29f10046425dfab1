"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotalens.queries import QUERIES, load_all  # noqa: E402
from quotalens.session import local_session  # noqa: E402

HEADLINE = [
    "sales_grain_aggregate", "concentration_hhi", "mix_shift_first_zero", "customer_flow", "calendar_rolling_statistics", "temporal_detector_scores", "peer_review_queue",
    "return_linkage_as_of", "incentive_calculation", "forecast_backtest_metrics", "capacity_calendar",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cpus, partitions=8, memory="16g")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads and the file cache
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
