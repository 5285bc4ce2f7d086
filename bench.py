"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built from the parquet tables and collected; one warm-up pass, then the median of
three timed runs.  ``dashboard_update`` mimics one filter change of the dashboard: the cleaned
movements are cached once (as the reference keeps them in memory), then the KPI row and the seven
panels are computed for a state slice.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from atoflow.operators.filters import Filters  # noqa: E402
from atoflow.plans import catalog, panels  # noqa: E402
from atoflow.session import get_session  # noqa: E402


def _run(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session()
    names = only or list(catalog.SPARK)
    times: dict[str, float] = {}
    for name in names:
        build = catalog.SPARK[name]
        _run(lambda: build(spark, sf_dir).collect())  # warm-up
        times[name] = round(statistics.median(_run(lambda: build(spark, sf_dir).collect()) for _ in range(reps)), 3)

    mov = catalog.mov_c(spark, sf_dir).cache()
    mov.count()
    f = Filters(estado="EUROPE")

    def one_update():
        view = panels.update(mov, f, cache=False)  # the base table is cached already
        for df in (view.cards, view.flow, view.balance, view.series, view.timeline, view.agencies,
                   view.agencies_period, view.summary, view.reading):
            df.collect()

    one_update()
    times["dashboard_update"] = round(statistics.median(_run(one_update) for _ in range(reps)), 3)
    mov.unpersist()
    total = round(sum(v for k, v in times.items() if k != "dashboard_update"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_medians", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
