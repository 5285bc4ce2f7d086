"""One filter change of the dashboard: the slice, its KPI row and the seven panels.

``update`` returns lazy DataFrames; the caller collects what it shows.  The slice is cached when
several panels will be collected (each panel re-aggregates the same rows), and released with
``DashboardView.release()``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import periodo_anos
from ..operators import agencies, flows, kpis, timelines
from ..operators.filters import Filters, slice_movements


@dataclass
class DashboardView:
    slice: DataFrame
    cards: DataFrame
    flow: DataFrame
    balance: DataFrame
    series: DataFrame
    timeline: DataFrame
    agencies: DataFrame
    agencies_period: DataFrame
    summary: DataFrame
    reading: DataFrame

    def release(self) -> None:
        self.slice.unpersist()


def update(mov_c: DataFrame, f: Filters, cache: bool = True, timeline_grain: str = "auto") -> DashboardView:
    """Build every panel for the filters ``f``.

    The agency panel's period text follows the page: the selected years when a year filter is
    set, else the years present in the state slice before the year filter.
    """
    by_state = slice_movements(mov_c, Filters(estado=f.estado))
    if f.anos:
        years = mov_c.sparkSession.createDataFrame([(list(f.anos),)], "anos array<int>")
    else:
        years = by_state.agg(F.collect_set("ano").alias("anos"))
    period = years.select(periodo_anos("anos").alias("periodo"))
    dff = slice_movements(mov_c, f)
    if cache:
        dff = dff.cache()
    return DashboardView(
        slice=dff,
        cards=kpis.kpi_cards(dff),
        flow=flows.government_flow(dff),
        balance=flows.government_balance(dff),
        series=timelines.government_series(dff),
        timeline=timelines.government_timeline(dff, grain=timeline_grain),
        agencies=agencies.agency_flow_top(dff),
        agencies_period=period,
        summary=flows.government_summary(dff),
        reading=kpis.slice_reading(dff),
    )
