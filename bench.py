"""Benchmark: headline cohort queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs as a full ``noop`` write (every row computed, nothing collected to
the driver), three times: the first (cold) run pays JVM JIT and code generation;
the reported warm time is the best of the next two. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from claims_cohorts.session import local_session  # noqa: E402
from claims_cohorts.plans import queries as Q  # noqa: E402

HEADLINE = [
    "combined_cohorts",
    "cohort_IBS_D",
    "cohort_CAD_Conservative",
    "cohort_HTN_Conservative",
    "prediabetes",
    "metabolic_syndrome",
    "pcos",
    "cardio_sensitive",
    "symptom_flag",
    "lookback_exclusion",
    "member_tags",
    "enrollment_filter",
    "clean_period",
    "cohort_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="claims_cohorts_bench")
    qs = Q.all_queries()
    # warm-up: JVM, file listing and codegen caches
    qs["index_first_pair"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, times = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        cold[name] = round(runs[0], 3)
        times[name] = round(min(runs[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "cohort_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold_value": round(sum(cold.values()), 3),
                "cold_queries": cold,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
