"""Print a one-line plan summary per query: scans, exchanges, single-partition exchanges,
nested-loop / cartesian joins, Python stages, windows. Usage: plan_audit.py [sf_dir] [names]."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from kindling.plans.queries import QUERIES
    from kindling.session import build_session

    spark = build_session()
    for name in sys.argv[2:] or sorted(QUERIES):
        if name.startswith("fit_"):
            continue
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        flags = {
            "scan": plan.count("FileScan") + plan.count("Scan ExistingRDD"),
            "xchg": len(re.findall(r"Exchange (hash|range|Single|Round)", plan)),
            "single": plan.count("SinglePartition"),
            "bnlj": plan.count("BroadcastNestedLoopJoin"),
            "cart": plan.count("CartesianProduct"),
            "model": len(re.findall(r"Exchange hashpartitioning\(model#\d+, \d+\)", plan)),
            "py": plan.count("MapInArrow") + plan.count("InArrow [") + plan.count("MapInPandas") + plan.count("ArrowEvalPython") + plan.count("BatchEvalPython"),
            "win": plan.count("Window ["),
            "bhj": plan.count("BroadcastHashJoin"),
            "smj": plan.count("SortMergeJoin"),
        }
        print(name, " ".join(f"{k}={v}" for k, v in flags.items()), flush=True)


if __name__ == "__main__":
    main()
