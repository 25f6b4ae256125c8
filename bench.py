"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from plumbline.session import local_session

HEADLINE = (
    "analyze_lineitem",
    "analyze_quality",
    "iqr_fences",
    "duplicate_rows",
    "duplicate_documents",
    "clean_data",
    "cleaning_report",
    "imputation_accuracy",
    "duplicate_fix",
    "outlier_fix",
    "quality_run",
    "vector_topk",
    "text_topk",
    "topk_fallback",
    "csv_roundtrip",
    "stream_ingest",
    "trust_forest",
)
WARM_UP = ("analyze_quality", "clean_data", "text_topk", "trust_forest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    # The first run compiles code and fits the forest, which is kept.
    for name in WARM_UP:
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
