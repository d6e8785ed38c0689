"""Times the headline queries and prints one JSON line.

Each query runs twice and the second, warm run counts. Rows go to Spark's no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from basketry.catalog import QUERIES  # noqa: E402
from basketry.session import local_session  # noqa: E402

HEADLINE = [
    "scan_lines",
    "visit_scalars",
    "dept_group_share",
    "dept_share",
    "fineline_share",
    "dept_line_counts",
    "dept_scan_counts",
    "fineline_scan_counts",
    "upc_indicator_counts",
    "tfidf_visit",
    "chi2_scores",
    "visit_feature_matrix",
    "prepare_train",
    "describe_numeric",
    "histogram_50",
    "value_counts_sorted",
    "dept_finelines",
    "upc_train_not_test",
    "pairwise_distances",
    "knn_join",
    "log_loss",
    "final_predictions",
    "ensemble_mean",
    "pred_sink",
    "rf_probs",
]


def seconds(spark, directory: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in names:
        seconds(spark, directory, name)
        times[name] = round(seconds(spark, directory, name), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(directory).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
