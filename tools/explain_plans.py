"""Summarize physical plans of registered queries (after their materialized stages).

usage: python tools/explain_plans.py [sf_dir] key ...
Prints exchanges, join strategies, window operators and scan pushdown per query.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from tidemark.plans import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def summarize(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange (hash|range|single|round)", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "windows": plan.count("Window ["),
        "scans": plan.count("FileScan parquet"),
        "pushed_filter_scans": len([m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m.strip()]),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    qs = catalog.queries()
    for key in sys.argv[2:]:
        df = qs[key](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(key, summarize(plan))


if __name__ == "__main__":
    main()
