"""Print, per registered query, the physical-plan operators that matter at
scale: exchanges, broadcast vs sort-merge joins, nested-loop / cartesian
joins (must be none), window-group limits, scans and their pushed filters."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from autokpi.plans.registry import QUERIES, load_all  # noqa: E402
from autokpi.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    load_all()
    spark = get_spark()
    bad = 0
    for name, fn in QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf).explain(mode="simple")
        plan = buf.getvalue()
        cnt = {k: len(re.findall(k, plan)) for k in
               ("Exchange hashpartitioning", "Exchange SinglePartition", "Exchange rangepartitioning",
                "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
                "WindowGroupLimit", "FileScan")}
        flag = cnt["BroadcastNestedLoopJoin"] + cnt["CartesianProduct"]
        bad += flag > 0
        print(("!! " if flag else "   ") + name, {k: v for k, v in cnt.items() if v})
    print("queries with nested-loop/cartesian joins:", bad)


if __name__ == "__main__":
    main()
