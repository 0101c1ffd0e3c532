"""Headline timings: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is planned and run to its end into a no-op sink,
once to warm up and once timed (those in ONCE are timed at once).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "feature_row", "f8_customer_counts", "f30_merchant_customers", "f33_distinct_payers", "j15_account_state",
    "d1_rule_layer", "a6_confusion_and_cost", "a7_recall_by_group", "d7_cost_optimal_threshold", "v1_roc_auc",
    "v4_roc_points", "k2_temporal_split", "g5_account_activity", "b4_frozen_measure", "m6_term_counts",
    "a15_column_medians", "x1_reason_codes", "st1_st2_st3_online_features", "m1_boosted_trees",
]

# Jobs of many stages: timed once, without a run to warm up.
ONCE = {"x1_reason_codes", "st1_st2_st3_online_features", "m1_boosted_trees"}


def shuffled_mb(spark) -> float:
    """Shuffle bytes written by all executors so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) / 1e6


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from ledgerscope.queries import QUERIES
    from ledgerscope.session import local_session

    spark = local_session(cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times, moved = {}, {}
    for name in HEADLINES:
        for _ in range(1 if name in ONCE else 2):
            start, before = time.perf_counter(), shuffled_mb(spark)
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            moved[name] = round(shuffled_mb(spark) - before, 1)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "feature_rows_per_second": round(rows / times["feature_row"], 1), "ledger_rows": rows, "shuffle_write_mb": moved,
    }))


if __name__ == "__main__":
    main()
