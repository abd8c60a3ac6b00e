"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinscan.plans.queries import QUERIES  # noqa: E402
from twinscan.session import build_session  # noqa: E402

HEADLINE = [
    "document_pairs",
    "document_alerts",
    "document_similarity",
    "file_similarity",
    "shared_blocks",
    "graph_edges",
    "function_list",
    "tokenize_documents",
    "token_profile",
    "submission_sequences",
    "candidate_pairs",
    "candidate_counts",
    "exclude_existing",
    "similarity_statistics",
    "similarity_overview",
    "bidirectional_similarities",
    "submission_statistics",
    "upsert_submissions",
    "cascade_delete",
    "rule_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("twinscan-bench", f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
