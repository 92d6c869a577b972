"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m2_auc_lineitem",
    "m21_metric_row",
    "m22_breakdown_report",
    "m11_bootstrap_ci",
    "m18_risk_coverage",
    "a3_distribution_skew",
    "a6_leak_report",
    "a7_seed_aggregation",
    "a13_slice_accuracy",
    "j3_near_duplicates",
    "p8_grounding",
    "w1_suspicious_segments",
    "w7_face_track",
    "w9_offset_search",
    "r3_drift_stream",
    "r4_job_state_stream",
]


def main() -> None:
    from touchstone.plans import catalog
    from touchstone.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "touchstone-bench", int(cpus) if cpus.isdigit() else 8)
    # The first query of a session pays for class loading and code generation.
    catalog.QUERIES["m2_auc"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
