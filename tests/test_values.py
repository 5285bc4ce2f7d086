"""Labels by value dictionary equal the labels computed per row; filters on them read the dictionary."""

import pytest
from pyspark.sql import functions as F

from atoflow import constants as K
from atoflow.operators import timelines
from atoflow.operators.cleanse import clean_movements, clean_movements_by_value, value_dictionary
from atoflow.operators.filters import Filters, slice_movements, slice_raw
from atoflow.plans import catalog
from atoflow.sources import fixtures

from .conftest import SF_SMALL

GOVERNORS = [None, "", "  ", " - ", "Sergio Cabral", "Sergio Cabral - Governador", " Sergio Cabral  - Governador ",
             "Fulano - Governador em exercicio", "Nao identificado", "A - B - C", "\u00a0Rodrigo Bacellar - Governador em exercicio"]
TITLES = [None, "", " Governador - Titular", "Secretário de Estado", "SUBSECRETARIO", "outro", "governadora"]


def awkward(spark):
    rows = [(i, "RJ", f"p{i}", "2020-01-15", K.NOMEACAO, "X", TITLES[i % 7], GOVERNORS[i % 11], "clash", "clash")
            for i in range(154)]
    return spark.createDataFrame(rows, "mov_id long, estado string, nome_normalizado string, data_publicacao string, tipo_ato string,"
                                       " orgao string, cargo_assinante string, governador_edicao string, valor string, autoria_ato string")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_same_rows_as_per_row_rules(spark):
    for mov in (awkward(spark), awkward(spark).drop("governador_edicao", "cargo_assinante"), awkward(spark).limit(0),
                awkward(spark).union(awkward(spark)), fixtures.movements(spark, SF_SMALL)):
        want, got = clean_movements(mov), clean_movements_by_value(mov)
        assert got.dtypes == want.dtypes
        assert rows_of(got) == rows_of(want)


def test_dictionary_has_each_value_once(spark):
    values = value_dictionary(awkward(spark))
    assert values.count() == values.select("campo", "valor").distinct().count() == len(GOVERNORS) + len(TITLES)


@pytest.mark.parametrize("f", [
    catalog.SLICE, Filters(representantes=catalog.FEW), Filters(autorias=(K.AUTORIA_GOVERNADOR,)), Filters(anos=(1996,)),
    Filters(estado="NOWHERE", representantes=("ninguem",)), Filters()])
def test_slice_equals_the_filtered_clean_table(spark, f):
    mov = fixtures.movements(spark, SF_SMALL)
    assert rows_of(slice_raw(mov, f)) == rows_of(slice_movements(clean_movements(mov), f))


def test_label_predicate_is_read_from_the_dictionary(spark):
    plan = slice_raw(fixtures.movements(spark, SF_SMALL), Filters(representantes=catalog.FEW))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    label = [line for line in scans if "representante_origem" in line]
    assert len(label) == 1 and "campo" in label[0]
    assert "regexp" not in plan.lower() and "rlike" not in plan.lower()  # no rule is evaluated per row
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("wanted", [catalog.FEW, ()])
def test_adaptive_grain_equals_the_chosen_grain(spark, wanted):
    df = slice_raw(fixtures.movements(spark, SF_SMALL), Filters(representantes=wanted))
    n = df.filter("data_movimentacao is not null").agg(F.countDistinct("representante_origem")).first()[0]
    grain = "month" if n <= K.ADAPTIVE_MONTH_MAX_GROUPS else "year"
    want, got = timelines.government_timeline(df, grain=grain), timelines.government_timeline(df)
    assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
