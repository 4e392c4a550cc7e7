"""Benchmark: the six reference queries, the one-pass report and the heavier extras.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is rebuilt for every run, listing and analysis included (a re-collected DataFrame would
reuse its finished shuffle stages; nothing is kept between runs). After one warm-up pass over all queries, each is run once more and then ``BENCH_RUNS``
times; the median is reported. Small results are collected; row-level results go to the ``noop`` sink. Prints one JSON
line; ``value`` is the sum of the Q1-Q6 medians.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loyalscope.plans.registry import QUERIES  # noqa: E402
from loyalscope.plans.report import nps_report  # noqa: E402
from loyalscope.session import get_session  # noqa: E402
from loyalscope.sources import fixtures as fx  # noqa: E402

HEADLINE = {
    "q1_overall_nps": "overall_nps",
    "q2_segment_nps": "segment_nps",
    "q3_monthly_trend": "monthly_trend",
    "q4_device_age_nps": "device_age_nps",
    "q5_segment_benchmark": "segment_benchmark",
    "q6_negative_drivers": "negative_drivers",
}
EXTRA = {
    "report_q1_to_q6_one_pass": "report",
    "x1_segment_rollup": "segment_rollup",
    "x3_driver_coverage": "driver_coverage",
    "x7_detractor_words": "detractor_words",
    "x8_recovery_transitions": "recovery_transitions",
    "v1_input_checks": "input_checks",
}
ROW_LEVEL = {"detractor_words"}


def _run_report(spark, sf_dir: str) -> float:
    """Q1-Q6 from one checkpointed pass (``nps_report``), all six results collected."""
    t0 = time.perf_counter()
    for df in nps_report(fx.reviews_view(spark, sf_dir), fx.user_attributes_view(spark, sf_dir)).values():
        df.collect()
    return time.perf_counter() - t0


def _run_once(spark, name: str, sf_dir: str) -> float:
    if name == "report":
        return _run_report(spark, sf_dir)
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    if name in ROW_LEVEL:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_session(cores=cpus)
    timings: dict[str, float] = {}
    plan = {**HEADLINE, **EXTRA}
    for name in plan.values():          # one pass to warm the JVM (JIT, class loading) for all
        _run_once(spark, name, sf_dir)
    for label, name in plan.items():
        _run_once(spark, name, sf_dir)
        samples = [_run_once(spark, name, sf_dir) for _ in range(runs)]
        timings[label] = round(statistics.median(samples), 4)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "q1_to_q6_median_total",
        "value": round(sum(timings[k] for k in HEADLINE), 4),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "runs": runs,
        "spark": spark.version,
        "cores": cpus,
        "driver_memory": spark.conf.get("spark.driver.memory", None),
        "python": platform.python_version(),
    }))


if __name__ == "__main__":
    main()
