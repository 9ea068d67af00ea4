"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.session import get_session  # noqa: E402
from tabloom.workload.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "pr01_missing_by_column",
    "pr09_top_values",
    "pr10_numeric_stats",
    "pr12_profile_columns",
    "pr13_schema_summary",
    "ed02_duplicate_analysis",
    "ed03_numeric_statistics",
    "ed04_outlier_analysis",
    "ed05_correlation_matrix",
    "ed07_quality_score",
    "tr12_drop_duplicates",
    "tr13_iqr_clip",
    "tr15_apply_recipe",
    "ch06_histogram_auto",
    "ch12_scatter_sample",
    "ch13_daily_mean",
    "dr03_psi_numeric",
    "dr04_ks",
    "dr08_column_drift",
    "fe11_tfidf",
    "su05_logistic_regression",
    "su10_linear_regression",
    "su19_classification_metrics",
    "su20_roc_auc",
    "sc04_threshold_analysis",
    "un01_kmeans",
    "un04_davies_bouldin",
    "un06_knn_join",
    "lc10_job_state",
    "st02_follow_job_state",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "tabloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            # Small local files: split them so that every core has a share.
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "1m",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executor
    seconds = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
