"""State-directory discovery, CSV/parquet scans, reload and the partitioned sink."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from atoflow.sources import states


def write_state(root, uf, mov=True, csv=True, csv_cols=None):
    d = os.path.join(root, uf)
    os.makedirs(d, exist_ok=True)
    if mov:
        pd.DataFrame({"nome_normalizado": ["ANA", "BIA", "ANA"],
                      "data_publicacao": ["2020-01-05", "2020-02-01", "bad"],
                      "tipo_ato": ["exoneracao", "nomeacao", "nomeacao"],
                      "orgao": ["SEC A", None, "SEC  A"], "cargo_assinante": ["Governador", "", None],
                      "governador_edicao": ["Sergio Cabral - Governador", "", None],
                      "extra": [1, 2, 3]}).to_parquet(os.path.join(d, "movimentacoes_pessoas.parquet"))
    if csv:
        data = {"nome_normalizado": ["ANA", "CAIO"], "data_publicacao": ["2020-03-01", "2021-01-01"],
                "data_exoneracao_anterior": ["2020-01-05", "NA"], "orgao": ["SEC A", "SEC B"],
                "mudou_cargo_desde_exoneracao": ["Sim", ""], "mudou_orgao_desde_exoneracao": ["nao", "nan"],
                "dias_desde_exoneracao": ["56", ""], "other": ["x", "y"]}
        cols = csv_cols or list(data)
        pd.DataFrame({c: data[c] for c in cols}).to_csv(os.path.join(d, "retornos_apos_exoneracao.csv"), index=False)


def test_discovery_and_scans(spark, scratch):
    write_state(scratch, "rj")
    write_state(scratch, "sp", csv_cols=["nome_normalizado", "data_publicacao", "orgao"])
    write_state(scratch, "mg", csv=False)
    found = states.complete_states(spark, scratch)
    assert [s for s, _ in found] == ["RJ", "SP"]
    ret_c, mov_c = states.reload(spark, scratch)
    assert sorted(r[0] for r in mov_c.select("estado").distinct().collect()) == ["RJ", "SP"]
    assert mov_c.count() == 6
    assert mov_c.filter(F.col("data_movimentacao").isNull()).count() == 2
    rj = {r["pessoa"]: r for r in ret_c.filter(F.col("estado") == "RJ").collect()}
    assert rj["ANA"]["dias_desde_exoneracao"] == 56 and rj["ANA"]["tempo_cluster"] == "medio"
    assert rj["ANA"]["mudou_cargo"] is True and rj["ANA"]["mudou_orgao"] is False
    assert rj["CAIO"]["tempo_cluster"] == "desconhecido" and rj["CAIO"]["data_exoneracao"] is None
    assert rj["CAIO"]["mudou_cargo"] is True and rj["CAIO"]["mudou_orgao"] is True  # "" and "nan" read as NaN, truthy
    sp = ret_c.filter(F.col("estado") == "SP").collect()
    assert all(r["governador_edicao"] == "Nao identificado" for r in sp)


def test_no_complete_state_raises(spark, scratch):
    write_state(scratch, "mg", csv=False)
    with pytest.raises(FileNotFoundError):
        states.complete_states(spark, scratch)


def test_partitioned_sink_prunes(spark, scratch):
    src = os.path.join(scratch, "in")
    write_state(src, "rj")
    write_state(src, "sp")
    _, mov_c = states.reload(spark, src)
    out = os.path.join(scratch, "out")
    states.write_partitioned(mov_c, out)
    back = spark.read.parquet(out).filter(F.col("estado") == "RJ")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and back.count() == 3


@pytest.mark.parametrize("written,expected", [
    (["True", "False", ""], [True, False, True]), (["1", "0", "2.0"], [True, False, True]),
    (["sim", "True", "1"], [True, False, False]), (["Sim", "nao", ""], [True, False, True])])
def test_change_flags_follow_the_whole_column(spark, scratch, written, expected):
    """Booleans and numbers count by value, other columns by 'sim'; a gap is true."""
    write_state(scratch, "rj")
    pd.DataFrame({"nome_normalizado": ["A", "B", "C"], "data_publicacao": ["2020-03-01"] * 3,
                  "mudou_cargo_desde_exoneracao": written}).to_csv(
        os.path.join(scratch, "rj", "retornos_apos_exoneracao.csv"), index=False)
    ret, _ = states.reload(spark, scratch)
    assert [r["mudou_cargo"] for r in ret.orderBy("pessoa").collect()] == expected


def test_missing_movement_column_is_an_error(spark, scratch):
    write_state(scratch, "rj")
    path = os.path.join(scratch, "rj", "movimentacoes_pessoas.parquet")
    pd.read_parquet(path).drop(columns="tipo_ato").to_parquet(path)
    with pytest.raises(ValueError):
        states.reload(spark, scratch)


def test_part_files_keep_the_state_of_the_folder_above(spark, scratch):
    write_state(scratch, "rj")
    d = os.path.join(scratch, "rj2")
    whole = spark.read.parquet(os.path.join(scratch, "rj", "movimentacoes_pessoas.parquet"))
    whole.repartition(3).write.parquet(os.path.join(d, "movimentacoes_pessoas.parquet"))
    got = states.read_movements(spark, [os.path.join(scratch, "rj"), d]).groupBy("estado").count().collect()
    assert {r["estado"]: r["count"] for r in got} == {"RJ": 3, "RJ2": 3}


def test_state_names_are_those_of_the_folders(spark, scratch):
    for name in ("middle east", "são paulo", "a%20b", "a+b"):
        write_state(scratch, name)
    names = [s for s, _ in states.complete_states(spark, scratch)]
    assert names == ["A%20B", "A+B", "MIDDLE EAST", "SÃO PAULO"]
    for table in states.reload(spark, scratch):
        assert sorted(r[0] for r in table.select("estado").distinct().collect()) == names
