"""Movements and returns inputs derived from the driver tables (see FIXTURES.md §2).

The movements view is shared SQL text: Spark runs it with the tables bound as DataFrame
parameters, the DuckDB oracle runs the same text over its views.  The returns view needs ordered
per-person windows; Spark computes them with the skew-split ``neighbours`` operator, the
oracle with plain SQL windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.sequences import day_and_id_block, neighbours
from ..session import discard, materialize, shared_folder
from .tables import table

MOV_SQL = """
SELECT o.o_orderkey AS mov_id, r.r_name AS estado, c.c_name AS nome_normalizado,
       CAST(o.o_orderdate AS DATE) AS data_publicacao,
       CASE WHEN o.o_orderkey % 97 = 0 OR (o.o_orderkey % 13 = 0 AND o.o_custkey % 9 = 4) THEN NULL
            WHEN o.o_orderstatus = 'F' THEN 'exoneracao' WHEN o.o_orderstatus = 'O' THEN 'nomeacao' ELSE 'outro' END AS tipo_ato,
       CASE o.o_orderkey % 5 WHEN 0 THEN concat(n.n_name, ' - DEPTO') WHEN 1 THEN concat(n.n_name, '-Depto')
            WHEN 2 THEN concat(lower(n.n_name), '  -depto') WHEN 3 THEN concat(n.n_name, ' / SUB') ELSE '' END AS orgao,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Governador - Titular' WHEN '2' THEN 'Secretário de Estado'
            WHEN '3' THEN '  SUBSECRETARIO - X' WHEN '4' THEN '' ELSE NULL END AS cargo_assinante,
       CASE WHEN o.o_orderkey % 13 = 0 THEN concat('Pessoa ', o.o_custkey % 9, CASE WHEN o.o_orderkey % 2 = 0 THEN ' - Governador' ELSE ' - Governador em exercicio' END)
            ELSE CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Sergio Cabral - Governador'
            WHEN 'BUILDING' THEN 'Francisco Dornelles - Governador em exercicio'
            WHEN 'FURNITURE' THEN 'Rodrigo Bacellar - Governador em exercicio'
            WHEN 'HOUSEHOLD' THEN 'Fulano de Tal - Governador em exercicio' ELSE '' END END AS governador_edicao
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Gazette lines by doc_id, ahead of the document's text or (every third) behind it.
GAZETTE_SQL = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(coalesce(text, ''), chr(10), linhas) ELSE concat(linhas, chr(10), coalesce(text, '')) END AS text
FROM (SELECT doc_id, text, CASE doc_id % 16
  WHEN 0 THEN concat('DIARIO OFICIAL', chr(10), 'THIAGO PAMPOLHA GOVERNADOR EM EXERCICIO', chr(10), 'FIM')
  WHEN 1 THEN concat('ATOS DO PODER EXECUTIVO', chr(10), 'RODRIGO BACELLAR', chr(10), 'GOVERNADOR EM EXERCÍCIO')
  WHEN 2 THEN concat('DESPACHOS DO GOVERNADOR EM EXERCICIO', chr(10), 'NOMEIA FULANO', chr(10), chr(10), 'RICARDO COUTO', chr(10), 'ID 123')
  WHEN 3 THEN concat('GOVERNADOR EM EXERCICIO DO ESTADO', chr(10), 'VICE-GOVERNADOR THIAGO PAMPOLHA ATOS DO DIA')
  WHEN 4 THEN 'GOVERNADOR CLAUDIO BOMFIM DE CASTRO E SILVA VICE-GOVERNADOR THIAGO PAMPOLHA'
  WHEN 5 THEN concat('ATOS DO GOVERNADOR EM EXERCICIO', chr(10), repeat('X', 6000), chr(10), 'GOVERNADOR  EM EXERCÍCIO', chr(10), 'THIAGO PAMPOLHA')
  WHEN 6 THEN concat('RODRIGO BACELLAR', chr(10), repeat('X ', 200), chr(10), 'GOVERNADOR EM EXERCICIO')
  WHEN 7 THEN concat('RODRIGO BACELLAR', chr(10), 'DECRETO DO GOVERNADOR EM EXERCICIO')
  WHEN 8 THEN 'O Governador Sérgio Cabral'
  WHEN 9 THEN concat('GOVERNADOR EM EXERCICIO', chr(10), '- CLÁUDIO  CASTRO - GOVERNADOR EM EXERCICIO ID: 4 5 x')
  WHEN 10 THEN concat(repeat('Y', 14990), chr(10), 'GOVERNADOR WILSON JOSE WITZEL')
  WHEN 11 THEN concat('Governador Wilson José Witzel', chr(10), 'Governador em exercício', chr(10), 'XRICARDO COUTO')
  WHEN 12 THEN concat('GOVERNADOR EM EXERCICIO', chr(10), repeat('Z', 5100), chr(10), 'LUIZ FERNANDO DE SOUZA')
  WHEN 13 THEN concat('GOVERNADOR EM EXERCICIO', chr(10), 'THIAGO PAMPOLHA VICE-GOVERNADOR', chr(10), 'RODRIGO BACELLAR')
  WHEN 14 THEN concat('GOVERNADOR EM EXERCICIO', chr(10), 'RICARDO GOVERNADOR COUTO')
  ELSE '' END AS linhas FROM {documents})
"""


def gazette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, text): every document with the gazette lines that its id picks."""
    return spark.sql(GAZETTE_SQL, documents=table(spark, sf_dir, "documents"))


#: How the states' files write the change flags, in turn by state name; one state has no returns file.
FLAG_SPELLINGS = (("True", "False"), ("1", "0"), ("sim", "nao"))
INCOMPLETE_STATE = "AFRICA"


def state_folders(spark: SparkSession, sf_dir: str) -> str:
    """Write the per-state input layout from the movements and returns views; returns its root.

    The folder lies under the session's checkpoint folder and is deleted when the application ends.
    Every state of the movements has a folder.  Both tables are computed once; each state's files are
    folders of part files.
    """
    root = shared_folder(spark, "states")
    mov, ret = materialize(movements(spark, sf_dir), "mov"), materialize(returns(spark, sf_dir), "ret")
    states = [r.estado for r in mov.select("estado").filter("estado is not null").distinct().orderBy("estado").collect()]
    for i, state in enumerate(states):
        here = f"{root}/{state.lower()}"
        mov.filter(F.col("estado") == state).select(*K.COLUNAS_MOVIMENTACAO, F.lit("x").alias("outra")).write.parquet(
            f"{here}/{K.ARQUIVO_MOVIMENTACOES}")
        if state != INCOMPLETE_STATE:
            yes, no = FLAG_SPELLINGS[i % len(FLAG_SPELLINGS)]
            flags = {c: F.when(F.col(c) == "sim", F.lit(yes)).when(F.col(c) == "nao", F.lit(no))
                     for c in ("mudou_cargo_desde_exoneracao", "mudou_orgao_desde_exoneracao")}
            (ret.filter(F.col("estado") == state).withColumns(flags).select(*K.COLUNAS_RETORNO).write
             .option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .csv(f"{here}/{K.ARQUIVO_RETORNOS}"))
    discard(mov)
    discard(ret)
    return root


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw movements: mov_id, estado, nome_normalizado, data_publicacao, tipo_ato, orgao,
    cargo_assinante, governador_edicao (one row per act)."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    return spark.sql(MOV_SQL, **t)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw returns after dismissal: every appointment preceded by a dismissal of the same person.

    Adds ``data_exoneracao_anterior`` (latest earlier dismissal), ``orgao_ant`` (agency of the
    previous act), ``dias_desde_exoneracao``, and the two 'sim'/'nao' change flags.
    """
    mov = movements(spark, sf_dir).filter(F.col("nome_normalizado").isNotNull())
    mov = mov.withColumn("__exo_date", F.when(F.col("tipo_ato") == "exoneracao", F.col("data_publicacao")))
    bucket, coarser = day_and_id_block(F.unix_date(F.col("data_publicacao")), "mov_id")
    seq = neighbours(
        mov, ["nome_normalizado"], ["data_publicacao", "mov_id"], bucket, coarser,
        lags={"orgao_ant": "orgao"}, prior_max={"data_exoneracao_anterior": "__exo_date"})
    ret = seq.filter((F.col("tipo_ato") == "nomeacao") & F.col("data_exoneracao_anterior").isNotNull())
    return ret.select(
        "mov_id", "estado", "nome_normalizado", "data_publicacao", "tipo_ato", "orgao", "cargo_assinante",
        "governador_edicao", "data_exoneracao_anterior", "orgao_ant",
        F.datediff("data_publicacao", "data_exoneracao_anterior").alias("dias_desde_exoneracao"),
        F.when(F.col("orgao") != F.col("orgao_ant"), F.lit("sim")).otherwise(F.lit("nao"))
        .alias("mudou_orgao_desde_exoneracao"),
        F.when(F.col("mov_id") % 3 == 0, F.lit("sim")).when(F.col("mov_id") % 3 == 1, F.lit("nao"))
        .alias("mudou_cargo_desde_exoneracao"),
    )
