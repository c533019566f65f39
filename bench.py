"""Headline queries at one scale factor; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the best run of each query is reported, after one
warm-up run of the first query that compiles the shared code paths).

Each query runs end to end from the parquet files into a no-op sink, so the
whole result is computed but nothing is collected to the driver. The test file
is one row group, which one task would scan; before the clock starts it is laid
out in as many files as there are CPUs, as a table of any size would be.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tonemill.plans import QUERIES  # noqa: E402
from tonemill.session import checkpoint_dir, get_spark  # noqa: E402

HEADLINE = (
    "label_rules",
    "confidence_stats",
    "label_counts",
    "label_valence",
    "label_ensemble",
    "label_with_scorer",
    "high_confidence",
    "ensemble_vote",
    "read_reviews",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus, app="tonemill-bench")
    checkpoint_dir(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    table = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    docs = table.count()
    sf_dir = tempfile.mkdtemp(prefix="tonemill-bench-")
    table.repartition(cpus).write.parquet(os.path.join(sf_dir, "documents.parquet"))

    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "documents": docs,
        "rules_rows_per_sec": round(docs / times["label_rules"], 1),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
