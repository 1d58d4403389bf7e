"""Bench: runs the headline queries and prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with the ``noop`` sink (no collect to the driver). Times are of this
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from soilcast.plans.queries import queries  # noqa: E402
from soilcast.session import local_session  # noqa: E402

HEADLINE = [
    "load_observations",
    "missing_profile",
    "numeric_summary",
    "quantile_summary",
    "correlations",
    "histogram",
    "impute_mean_by_season",
    "impute_iterative",
    "imputation_error",
    "out_of_fold",
    "leaderboard",
    "scenario_grid",
    "boosted_a",
    "tree_stack",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # session start-up, not timed
    times = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
