"""Literal-row tests for each cleaning/classification rule (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from atoflow import constants as K
from atoflow.functions import classify as C
from atoflow.functions.agency import orgao_chave, orgao_rotulo, orgao_utilizavel
from atoflow.functions.labels import periodo_anos, rotulo_governo_curto, rotulo_representante_curto
from atoflow.functions.text import ptbr_int, ustrip


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_authorship(spark):
    df = one_col(spark, ["Secretário de X", "SUBSECRETARIO", "Secretários", "Governador - Y", "Governadora",
                         "  Secretário ", None])
    S, G, O = K.AUTORIA_SECRETARIA, K.AUTORIA_GOVERNADOR, K.AUTORIA_OUTRO
    assert values(df, C.autoria_ato("v")) == [S, S, O, G, O, S, O]


def test_agency_label_and_key(spark):
    df = one_col(spark, ["Sec. A -B /  C", "sec. a - b/c", "-", "nan", "None", "   ", None])
    rot = values(df, orgao_rotulo("v"))
    assert rot == ["Sec. A - B/C", "sec. a - b/c", "-", "", "", "", ""]
    keys = values(df.withColumn("r", orgao_rotulo("v")), orgao_chave("r"))
    assert keys == ["sec. a b/c", "sec. a b/c", "", "", "", "", ""]
    assert values(df, orgao_utilizavel("v")) == [k != "" for k in keys]
    more = one_col(spark, [" - / - ", "--", "\t-\n", "a", "-x-", "NULL", "/"])
    keys = values(more.withColumn("r", orgao_rotulo("v")), orgao_chave("r"))
    assert values(more, orgao_utilizavel("v")) == [k != "" for k in keys]


def test_time_bucket(spark):
    df = one_col(spark, [None, -1, 0, 1, 29, 30, 180, 181], "int")
    assert values(df, C.tempo_cluster("v")) == ["desconhecido", "curto", "imediato", "curto", "curto", "medio",
                                                "medio", "longo"]


def test_flag(spark):
    df = one_col(spark, ["Sim", " sim ", "Não", None, ""])
    assert values(df, C.norm_bool("v")) == [True, True, False, True, False]
    assert values(df, C.norm_bool("v", null_as=False)) == [True, True, False, False, False]


def test_representative_and_origin(spark):
    df = one_col(spark, ["Name - Role", "Name", "A - B - C", "", "Cláudio Bomfim de Castro e Silva - Governador",
                         "Fulano - Governador em exercicio", "Ricardo Couto de Castro - Desembargador"])
    g = C.governador_limpo("v")
    assert values(df, C.representante(g)) == ["Name", "Name", "A", K.NAO_IDENTIFICADO,
                                              "Cláudio Bomfim de Castro e Silva", "Fulano", "Ricardo Couto de Castro"]
    assert values(df, C.origem(g)) == ["Executivo estadual", "Executivo estadual", "Executivo estadual",
                                       K.NAO_IDENTIFICADO, "Executivo estadual", "Vice-governadoria", "TJ-RJ"]
    clean = df.withColumn("g", g).withColumn("r", C.representante_de_limpo("g"))
    assert values(clean, "r") == values(df, C.representante(g))
    assert values(clean, C.origem_de_limpo("g", "r")) == values(df, C.origem(g))


def test_event_state(spark):
    df = spark.createDataFrame([("curto", True, False), ("longo", False, True)], "t string, c boolean, o boolean")
    assert [r[0] for r in df.select(C.estado_evento("t", "c", "o")).collect()] == [
        "N_curto_novo_cargo_mesmo_orgao", "N_longo_mesmo_cargo_novo_orgao"]


def test_period_text(spark):
    df = spark.createDataFrame([(0, []), (1, [2020]), (2, [2021, 2019, 2020]), (3, [2020, 2018, None])],
                               "i int, v array<int>")
    assert values(df, periodo_anos("v")) == ["sem período", "2020", "2019-2021", "2018, 2020"]


def test_short_labels(spark):
    df = one_col(spark, ["Luiz Fernando de Souza", "Sergio Cabral - Governador", "Fulano de Tal - X", "Solo"])
    assert values(df, rotulo_representante_curto("v")) == ["Luiz Souza", "Sergio Cabral", "Fulano Tal", "Solo"]
    assert values(df, rotulo_governo_curto("v")) == ["Luiz Fernando de Souza", "Sergio Cabral - Governador",
                                                     "Fulano Tal - X", "Solo"]


def test_ptbr_and_strip(spark):
    df = one_col(spark, [1234, -1234567, 0], "long")
    assert values(df, ptbr_int("v")) == ["1.234", "-1.234.567", "0"]
    df = one_col(spark, ["  x y ", "\x1c a\t\n"])
    assert values(df, ustrip("v")) == ["x y", "a"]
    assert values(df, F.length(ustrip("v"))) == [3, 1]


def test_accent_blind_origin(spark):
    df = one_col(spark, ["Cláudio Bomfim de Castro e Silva - Governador em exercicio"])
    g = C.governador_limpo("v")
    r = C.representante_de_limpo(g)
    assert values(df, C.origem_de_limpo(g, r)) == ["Vice-governadoria"]
    assert values(df, C.origem_de_limpo(g, r, accent_blind=True)) == ["Executivo estadual"]
