"""Seconds per headline query on local[$BENCH_CPUS] over $BENCH_SF_DIR, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyscope.plans.queries import QUERIES  # noqa: E402
from tallyscope.session import local_session  # noqa: E402

HEADLINES = [
    "ingest_accept",
    "ingest_log",
    "dedupe_first_wins",
    "monthly_cashflow",
    "income_features",
    "cashflow_features",
    "debt_features",
    "subscription_cleansing",
    "liquidity_pooling",
    "bill_shift_drift",
    "bill_shift_score",
    "nightly_features",
    "feature_vectors",
    "lead_ranking",
    "metric_auc",
    "capacity_quantiles",
    "intent_scores",
    "reason_codes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    # the first query also starts the JVM's code caches, so a small one goes first unmeasured
    QUERIES["customers_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
