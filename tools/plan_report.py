"""Write PLANS.md: the executed (AQE final) physical plan shape of every registered query.

Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from atoflow.plans import catalog  # noqa: E402
from atoflow.session import get_session  # noqa: E402


def final_plan(df) -> str:
    """The plan that ran, subqueries included: every initial plan is left out, by its indentation."""
    out, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :|+-"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "== Initial Plan ==" in line else None
        if hidden is None:
            out.append(line)
    return "\n".join(out)


def scans(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if "FileScan parquet" not in line:
            continue
        cols = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", line)
        loc = re.search(r"Location: [^\[]*\[[^\]]*?([\w.-]+)\]", line)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
        if cols and loc:
            c = re.sub(r"#\d+L?", "", cols.group(1))
            p = re.sub(r"#\d+L?", "", pushed.group(1)) if pushed else "[]"
            out.append(f"`{loc.group(1)}` [{c}] pushed {p}")
    return [f"{n} x {x}" if (n := out.count(x)) > 1 else x for x in sorted(set(out))]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    lines = ["# PLANS — executed plan shape per registered query",
             "",
             f"Generated by `tools/plan_report.py` at `{sf}` (local mode; AQE final plans, so broadcast choices",
             "reflect measured sizes at this scale). Counts are physical operators in the final plan: shuffle",
             "exchanges, exchanges reused instead of recomputed, broadcast exchanges, sort-merge and broadcast-hash",
             "joins, window operators, top-k (`TakeOrderedAndProject`) and Arrow Python stages. Scans list the",
             "columns actually read, the filters pushed into the parquet reader, and how often a scan occurs,",
             "scalar subqueries included. Jobs that run while a query is built (the steady state's rounds, the count",
             "of hot keys, the training-data operators' written tables) are not part of the plan.",
             "",
             "| query | shuffles | reused | broadcasts | SMJ | BHJ | windows | top-k | python | scans |",
             "|---|---|---|---|---|---|---|---|---|---|"]
    for name, build in catalog.SPARK.items():
        df = build(spark, sf)
        df.collect()
        p = final_plan(df)
        row = [name,
               len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)),
               p.count("ReusedExchange"), p.count("BroadcastExchange"), p.count("SortMergeJoin"),
               p.count("BroadcastHashJoin"), len(re.findall(r"\bWindow \[", p)), p.count("TakeOrderedAndProject"),
               p.count("ArrowEvalPython"), "<br>".join(scans(p))]
        lines.append("| " + " | ".join(str(x) for x in row) + " |")
        print(name, row[1:9], flush=True)
    with open("PLANS.md", "w") as fh:
        fh.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
