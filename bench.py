"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from regulith import catalog  # noqa: E402
from regulith.session import local_session  # noqa: E402

HEADLINE = [
    "x3_hybrid_search", "x1_vector_topk", "x2_text_rank", "x4_chunk_document", "x8_effective_date", "x11_entities", "x14_ontology_map",
    "x22_compose_answers", "x24_answer_batch", "x28_snapshot_from_pages", "a2_coverage_cube", "a4_query_stats", "a6_signal_stats", "a11_pack_summary",
    "a14_latency_percentiles", "a10_dedup_documents", "m1_upsert", "j7_mark_duplicates", "j10_contained_in", "p9_allow_domains", "w3_running_average",
    "t2_trailing_usage", "t8_trace_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    queries, _ = catalog.load()
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def rows(name: str) -> int:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()

    times: dict[str, float] = {}
    for name in wanted:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    docs, logs, orders = rows("documents"), rows("events"), rows("orders")
    per_second = {
        "documents_per_s": {n: round(docs / times[n]) for n in ("x4_chunk_document", "x8_effective_date", "x11_entities", "a10_dedup_documents", "m1_upsert") if n in times},
        "rows_per_s": {n: round(k / times[n]) for n, k in (("a4_query_stats", logs), ("a14_latency_percentiles", logs), ("a6_signal_stats", orders)) if n in times},
    }
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None, "throughput": per_second,
    }))


if __name__ == "__main__":
    main()
