
import datetime as dt

from pyspark.sql import functions as F

from atoflow.operators import agencies, flows, kpis, timelines, transitions
from atoflow.operators.cleanse import clean_movements, clean_returns

MOV_SCHEMA = ("mov_id long, estado string, nome_normalizado string, data_publicacao string, tipo_ato string, "
              "orgao string, cargo_assinante string, governador_edicao string")


def movements(spark, rows):
    return clean_movements(spark.createDataFrame(rows, MOV_SCHEMA))


def test_q1_null_keys_form_no_group(spark):
    mov = movements(spark, [(1, "RJ", "A", "2020-01-01", "nomeacao", "X", "", "Sergio Cabral - Governador"),
                            (2, "RJ", "B", "2020-01-02", None, "X", "", "Sergio Cabral - Governador")])
    assert [tuple(r) for r in flows.acts_by_year(mov).collect()] == [(2020, "nomeacao", 1)]
    assert kpis.kpi_cards(mov).first()["atos"] == 2  # but the row still counts as an act


def test_q2_null_person_has_no_next_event(spark):
    ret = clean_returns(spark.createDataFrame(
        [(1, "RJ", None, "2020-03-01", "2020-01-01", "X", "sim", "sim", 60),
         (2, "RJ", "P", "2020-03-01", "2020-01-01", "X", "sim", "sim", 60)],
        "mov_id long, estado string, nome_normalizado string, data_publicacao string, "
        "data_exoneracao_anterior string, orgao string, mudou_cargo_desde_exoneracao string, "
        "mudou_orgao_desde_exoneracao string, dias_desde_exoneracao int"))
    seq = transitions.event_sequence(ret)
    assert seq.filter(F.col("pessoa").isNull()).count() == 0
    assert [tuple(r) for r in transitions.transitions(seq).collect()] == [("E", "N_medio_novo_cargo_novo_orgao", 1)]


def test_q6_ties_are_broken_by_label(spark):
    mov = movements(spark, [(1, "RJ", "A", "2020-01-01", "nomeacao", "Beta", "", "Zeca - Governador"),
                            (2, "RJ", "B", "2020-01-01", "nomeacao", "Alfa", "", "Ana - Governador")])
    r = kpis.slice_reading(mov).first()
    assert r["governo_top"] == "Ana (Executivo estadual)" and r["orgao_top"] == "Alfa"
    trans = spark.createDataFrame([("b", "a", 2), ("a", "c", 2), ("a", "b", 2)], "evento string, prox_evento string, n long")
    assert [(r["evento"], r["prox_evento"], r["rank"]) for r in transitions.top_transitions(trans, 2).collect()] == [
        ("a", "b", 1), ("a", "c", 2)]


def test_q7_dates_parse_to_null_when_malformed(spark):
    mov = movements(spark, [(1, "RJ", "A", "2020-01-05", "nomeacao", "X", "", ""),
                            (2, "RJ", "A", "2020-01-05 10:30:00", "nomeacao", "X", "", ""),
                            (3, "RJ", "A", "05/01/2020", "nomeacao", "X", "", ""),
                            (4, "RJ", "A", "bad", "nomeacao", "X", "", ""),
                            (5, "RJ", "A", "2020-01-05T23:10:00.250", "nomeacao", "X", "", ""),
                            (6, "RJ", "A", "2020-13-01", "nomeacao", "X", "", ""),
                            *((10 + i, "RJ", "A", d, "nomeacao", "X", "", "") for i, d in enumerate(
                                ["T10:00", "2020", "2020-01", "2020-1-5", "2020-01-05x", "2020-02-30", "", None]))])
    zoned = movements(spark, [(7, "RJ", "A", "2020-01-05T23:00:00-03:00", "nomeacao", "X", "", ""),
                              (8, "RJ", "A", " 2020-01-05 00:30:00+09:00", "nomeacao", "X", "", "")])
    assert [r["data_movimentacao"] for r in zoned.collect()] == [dt.date(2020, 1, 5)] * 2
    got = {r["mov_id"]: (r["data_movimentacao"], r["ano"]) for r in mov.collect()}
    assert got == {1: (dt.date(2020, 1, 5), 2020), 2: (dt.date(2020, 1, 5), 2020), 3: (None, None), 4: (None, None),
                   5: (dt.date(2020, 1, 5), 2020), 6: (None, None), **{10 + i: (None, None) for i in range(8)}}


def test_acts_without_a_type(spark):
    """They count for an agency's rank and label, but a representative with no other acts has no row."""
    rows = [(i, "RJ", "A", "2020-01-05", t, o, "", g) for i, (t, o, g) in enumerate(
        [(None, "SEC Z", "Ana - Governadora")] * 5 + [("nomeacao", "Sec z", "Bia - Governadora")]
        + [("nomeacao", "Sec a", "Bia - Governadora")] * 2)]
    mov = movements(spark, rows)
    top = {r["orgao_chave"]: (r["ranking"], r["orgao_grafico"], r["quantidade"]) for r in agencies.agency_flow_top(mov).collect()}
    assert sorted(top.values()) == [(1, "SEC Z", 1), (2, "Sec a", 2)]
    for df in (flows.government_summary(mov), flows.government_balance(mov), flows.government_flow(mov)):
        assert [r["representante_origem"] for r in df.collect()] == ["Bia (Executivo estadual)"]


def test_sector_axis_keeps_ten_labels(spark):
    rows = [(100 * i + k, "RJ", "A", "2020-01-05", "nomeacao", "X", "", f"Setor{i:02d} - Chefe")
            for i in range(12) for k in range(i + 1)]
    mov = movements(spark, rows).withColumn("origem_representante", F.lit("Setor"))
    for df in (flows.government_flow(mov), flows.government_balance(mov)):
        assert sorted(r["representante_origem"][:7] for r in df.collect()) == [f"Setor{i:02d}" for i in range(2, 12)]
    mixed = mov.withColumn("origem_representante", F.when(F.col("mov_id") == 0, "Vice").otherwise("Setor"))
    assert flows.government_flow(mixed).count() == flows.government_balance(mixed).count() == 12


def test_q12_first_seen_order_follows_date_then_row(spark):
    mov = movements(spark, [(10, "RJ", "A", "2020-01-20", "nomeacao", "X", "", "Ana Souza - Governadora"),
                            (11, "RJ", "B", "2020-01-03", "nomeacao", "X", "", "Ana Souza - Vice"),
                            (12, "RJ", "C", "2020-01-20", "nomeacao", "X", "", "Ana Souza - Interina"),
                            (9, "RJ", "D", "2020-01-20", "nomeacao", "X", "", "Ana Souza - Governadora")])
    row = timelines.government_series(mov).first()
    assert row["papeis"] == "Vice / Governadora / Interina"
    assert row["quantidade"] == 4 and row["rotulo_serie"] == "Ana Souza (Executivo estadual)"


def test_q16_null_dates_count_in_kpis_not_in_timelines(spark):
    mov = movements(spark, [(1, "RJ", "A", "2020-01-01", "nomeacao", "X", "", ""),
                            (2, "RJ", "B", None, "exoneracao", "X", "", "")])
    assert kpis.kpi_cards(mov).first()["atos"] == 2
    assert timelines.acts_by_month(mov).agg(F.sum("quantidade")).first()[0] == 1
    assert timelines.government_timeline(mov, "month").agg(F.sum("quantidade")).first()[0] == 1
