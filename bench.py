"""Headline-query benchmark. Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, optional)
Each query is fully executed into the no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = ["b_runs", "c_task_index", "l_icu_death", "d_target_weight", "d_sample_weighted", "g_score_dispatch",
            "g_auroc", "e_context_text", "f_lift", "f_topk_pairs"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    qs = catalog.queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = [q for q in (wanted.split(",") if wanted else HEADLINE) if q in qs]
    # warm-up (JVM JIT, parquet footers, codegen caches) on the smallest table set;
    # nothing computed here is reused by the timed queries
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in ("b_runs", "c_task_index"):
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
