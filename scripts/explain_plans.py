"""Summarise the executed plan of each registered query: exchanges,
broadcast/sort-merge joins, Python stages and scans.

usage: python scripts/explain_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tonemill.plans import QUERIES  # noqa: E402
from tonemill.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if a != sf_dir] or list(QUERIES)
    spark = get_spark("local[8]")
    for name in names:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange (\w+)", plan)
        print(f"{name:28s} exchanges={exchanges} "
              f"BHJ={plan.count('BroadcastHashJoin')} SMJ={plan.count('SortMergeJoin')} "
              f"python={len(re.findall(r'MapInPandas|MapInArrow|ArrowEvalPython|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas', plan))} window={plan.count('Window [')} "
              f"generate={plan.count('Generate ')}")
    spark.stop()


if __name__ == "__main__":
    main()
