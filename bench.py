"""Times the headline queries and prints one JSON line.

Every query's full result is computed (written to Spark's no-op sink), after one
untimed warm-up of the session on the smallest query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditloom.session import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "pvc_value_counts",
    "p2_column_preview",
    "p5_numeric_stats",
    "p8a_spearman",
    "q8_column_issue_report",
    "q9_duplicates_lineitem",
    "q12_iqr_outliers",
    "q15_quality_score",
    "f3_target_rates_orders",
    "f4_intersectional_rates",
    "f10_knn_consistency",
    "m3_random_forest",
    "m5_group_metrics",
    "r1_reweight_pair",
    "r2_smote_vectors",
    "r3_oversample_multiclass",
    "r4_undersample_multiclass",
    "c3_compare_target_weighted",
    "t1_high_correlations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    QUERIES["b1_class_balance_multiclass"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
