"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from riskscope.catalog import QUERIES
from riskscope.session import build_session

HEADLINE = [
    "change_metrics",
    "risk_rate_by_brand",
    "attach_change_metrics",
    "parse_commit_log",
    "describe",
    "histogram_by_label",
    "mann_whitney",
    "pearson_pairs",
    "low_variance",
    "chi2_yates",
    "vif",
    "binary_metrics",
    "roc_auc",
    "average_precision",
    "group_report",
    "stratified_group_folds",
    "cv_summary",
    "top_rows",
    "text_size",
    "block_extract",
    "comment_strip",
    "rule_scan",
    "template_facts",
    "route_facts",
    "chunk_metadata",
    "scenarios",
    "render_files",
    "best_attempt",
    "uncovered_routes",
    "assemble_responses",
    "top_k",
    "knn_join",
    "hybrid_context",
    "related_classes",
    "forest_importances",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the executor threads and reads the tables' footers once, as a running service would have.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
