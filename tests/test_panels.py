"""The dashboard update builds every panel for a filter change and agrees with the parts."""

from atoflow.operators import flows, kpis
from atoflow.operators.filters import Filters, slice_movements
from atoflow.plans import catalog, panels

from .conftest import SF_SMALL


def test_update_panels(spark):
    mov = catalog.mov_c(spark, SF_SMALL)
    f = Filters(estado="ASIA", tipos=("nomeacao", "exoneracao"))
    view = panels.update(mov, f)
    try:
        assert view.cards.first()["atos"] == slice_movements(mov, f).count()
        assert sorted(map(tuple, view.summary.collect())) == sorted(
            map(tuple, flows.government_summary(slice_movements(mov, f)).collect()))
        assert view.reading.first()["registros"] == kpis.kpi_cards(slice_movements(mov, f)).first()["atos"]
        for df in (view.flow, view.balance, view.series, view.timeline, view.agencies):
            assert df.count() > 0
        assert view.agencies_period.first()["periodo"]
    finally:
        view.release()
    period = panels.update(mov, Filters(anos=(2019, 2021)), cache=False).agencies_period.first()["periodo"]
    assert period == "2019, 2021"
