"""Bench: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set).  Each query is fully
materialised (collect) and the cache is cleared before every timed query, so
one query's persisted corpus does not speed up the next.  Before timing, each
query runs once on the smallest tables (BENCH_WARMUP_DIR, untimed) so the JVM's
JIT and Spark's code generation are warm; nothing computed there is reused.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillrank.plans.catalog import QUERIES  # noqa: E402
from quillrank.session import local_session  # noqa: E402

HEADLINE = ["bm25_topk", "bm25_filtered", "dense_topk", "dense_topk_filtered", "rrf_fusion",
            "hybrid_retrieve", "rerank_topk", "retrieval_eval", "clean_records",
            "html_to_text", "qa_pairs_join", "log_metrics", "query_volume_hourly",
            "latency_by_stage", "score_histogram"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
             if n in QUERIES]
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    spark.range(10_000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in names:
            QUERIES[name](spark, warm).collect()
    times = {}
    for name in names:
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        rows = QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s rows={len(rows)}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
