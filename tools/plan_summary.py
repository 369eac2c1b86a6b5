"""Print the per-query plan summary table of PLANS.md: python tools/plan_summary.py <sf_dir>."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from talentscope.session import build_session
from talentscope.plans.catalog import QUERIES
from talentscope.plans.pipelines import tables_for, latest_for, matching_detail_for
from talentscope.operators import readiness, traits
spark = build_session("local[8]", shuffle_partitions=16)
d = sys.argv[1]
def summ(df):
    p = df._jdf.queryExecution().executedPlan().toString()
    ex = []
    for m in re.finditer(r"Exchange (hashpartitioning\(|SinglePartition)", p):
        if m.group(1) == "SinglePartition":
            ex.append("single partition"); continue
        i, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(p[i], 0); i += 1
        inner = re.sub(r"#\d+", "", p[m.end():i - 1])
        ex.append(inner.rsplit(", ", 1)[0])
    keys = sorted(set(f"({k})" if k != "single partition" else k for k in ex))
    return len(ex), p.count("SortMergeJoin"), p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin"), p.count("WindowGroupLimit"), "; ".join(keys)
t = tables_for(spark, d)
rows = [("(build) readiness_final", summ(readiness.readiness_final(t, latest_for(spark, d)))),
        ("(build) trait_vectors", summ(traits.trait_vectors(t))),
        ("(scan) matching_detail", summ(matching_detail_for(spark, d)))]
rows += [(n, summ(q(spark, d))) for n, q in QUERIES.items()]
print("| query | exchanges | sort-merge joins | broadcast joins | partial group limits | shuffle keys |")
print("| --- | --- | --- | --- | --- | --- |")
for n, (e, s, b, w, k) in rows:
    print(f"| `{n}` | {e} | {s} | {b} | {w} | {k or '-'} |")
