"""Tabulate the physical plan of every registered query (PLANS.md).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts operators in ``explain("formatted")`` of the initial adaptive plan:
scans, shuffles, broadcasts, join kinds, windows, sort-based aggregates, and
whether filters reached a Parquet scan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"churn_score", "upgrade_score", "model_auc", "feature_importances", "top_winback",
        "top_upsell", "score_scatter", "classification_report"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    from basketry.session import get_session
    from basketry.plans.registry import queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    cols = ["scans", "shuffles", "broadcasts", "SMJ", "BHJ", "BNLJ/cartesian", "windows",
            "sort aggs", "pushed filters"]
    print("| key | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for key, fn in queries().items():
        if key in SKIP:
            continue
        text = plan_text(fn(spark, sf_dir))
        tree = text.split("\n\n")[0]
        count = lambda pat: len(re.findall(pat, tree))
        pushed = len([m for m in re.findall(r"PushedFilters: \[(.*?)\]", text) if m.strip()])
        row = [count(r"Scan "), count(r"\bExchange \("), count(r"BroadcastExchange"),
               count(r"SortMergeJoin"), count(r"BroadcastHashJoin"),
               count(r"BroadcastNestedLoopJoin|CartesianProduct"), count(r"\bWindow "),
               count(r"SortAggregate"), pushed]
        print(f"| {key} | " + " | ".join(str(x) for x in row) + " |", flush=True)


if __name__ == "__main__":
    main()
