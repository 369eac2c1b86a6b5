"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_ALL=1   time every registered query, not only the headline set

Each query runs to completion through the ``noop`` sink (everything is
computed, nothing is collected to the driver).  The one-off derivation of
the talent tables from the driver tables is timed on its own
(``etl_tables``); every query after it reads those written tables.
JVM start-up and first-use class loading are paid by an untimed warm-up
(a tiny scan and aggregate); its time is printed as ``warmup_s`` and is
not part of ``value``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "readiness_final",
    "readiness_ranked",
    "shortlist_top3",
    "readiness_by_division",
    "pillar_avg_latest",
    "hp_by_grade",
    "hpd_by_mbti",
    "match_baseline",
    "benchmark_matching",
    "match_detail_top",
    "ranked_talent_top50",
    "candidate_insight",
    "candidate_top_bottom_tvs",
    "clean_competencies",
    "dq_duplicates",
    "dq_describe",
    "score_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))

    from talentscope.plans.catalog import QUERIES
    from talentscope.plans.pipelines import release, tables_for
    from talentscope.session import build_session

    shared = tempfile.mkdtemp(prefix="talentscope-bench-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark = build_session(f"local[{cpus}]", app_name="talentscope-bench", shuffle_partitions=2 * cpus,
                          extra={"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE

    t0 = time.perf_counter()
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    spark.range(100_000).selectExpr("id % 7 AS k", "id").groupBy("k").count().write.format("noop").mode(
        "overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    tables_for(spark, sf_dir)
    times["etl_tables"] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    release(spark)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "warmup_s": warmup,
    }))


if __name__ == "__main__":
    main()
