"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.plans import tables  # noqa: E402
from tidewatch.plans.registry import load_all  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = (
    "row_windows psi_categorical_by_window psi_numeric_quantile_by_window psi_numeric_sturges_by_window ks_test_by_window drift_events "
    "time_split_70_15_15 validate_report clean_encounters weighted_resample roc_auc recall_top_fraction subgroup_metrics metric_block "
    "policy_decisions gate_checks shadow_agreement lifecycle_state audit_log number_grounding attribution_top_n stream_drift_events "
    "stream_decisions backtest_end_to_end gbt_isotonic_score"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    known = load_all()
    known["row_windows"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    took: dict[str, float] = {}
    for name in names:
        tables.forget()  # each query pays for the derived tables it reads
        start = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
