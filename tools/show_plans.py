"""Write PLANS.md: physical plans of the main queries (lines shortened).

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.plans.registry import QUERIES  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

SHOW = ["classify_ids", "valid_ids", "provider_b_hits", "resolve", "resolve_chain", "resolve_skewed", "csv_rows",
        "summary_rows"]


def plan_text(df) -> str:
    df.collect()  # run it, so the adaptive plan shown is the final one
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    out = []
    for line in buf.getvalue().splitlines():
        line = re.sub(r"#\d+L?", "", line)
        out.append(line if len(line) <= 150 else line[:147] + "...")
    return "\n".join(out)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # show the large-data plan shapes
    parts = ["# Physical plans\n",
             "Generated by `tools/show_plans.py` with auto-broadcast disabled, so the plans show the",
             "shape used when every side is large (sort-merge joins, exchanges). Each query is run",
             "first, so these are the final adaptive plans (`ReusedExchange` marks a shuffle computed",
             "once and read twice). Long expressions are cut at 150 characters.\n"]
    for name in SHOW:
        parts += [f"## {name}\n", "```", plan_text(QUERIES[name](spark, sf)), "```\n"]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
