"""Writes the formatted physical plans of chosen registered queries (default: a representative set).

    python scripts/explain_plans.py [sf_dir] [name ...] > docs/PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from soilcast.plans.queries import queries  # noqa: E402
from soilcast.session import local_session  # noqa: E402

DEFAULT = ["numeric_summary", "quantile_summary", "impute_mean_by_season", "impute_iterative", "out_of_fold", "leaderboard"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    print("# Physical plans (local[*], 8 shuffle partitions, AQE on; before execution)\n")
    for name in names:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            qs[name](spark, sf).explain("formatted")
        print(f"## {name}\n\n```\n{buf.getvalue().strip()}\n```\n")


if __name__ == "__main__":
    main()
