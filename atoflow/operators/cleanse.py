"""Load-time cleaning and classification of the movements and returns tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import classify as C
from ..functions.text import blank_to
from ..session import materialize

MOV_COLUMNS = [
    "mov_id", "estado", "pessoa", "tipo_ato", "orgao", "cargo_assinante", "data_movimentacao", "ano",
    "autoridade_assinante", "autoria_ato", "governador_edicao", "representante_governo",
    "origem_representante", "representante_origem",
]

RET_COLUMNS = [
    "mov_id", "estado", "pessoa", "tipo_ato", "orgao", "cargo_assinante", "data_nomeacao",
    "data_exoneracao", "ano", "dias_desde_exoneracao", "autoridade_assinante", "autoria_ato",
    "governador_edicao", "representante_governo", "origem_representante", "representante_origem",
    "mudou_cargo", "mudou_orgao", "tempo_cluster", "estado_N",
]


ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?$"


def parse_date(df: DataFrame, name: str):
    """Date column, unparseable -> null: ``pd.to_datetime(errors='coerce')`` with ISO input."""
    if name not in df.columns:
        return F.lit(None).cast("date")
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    s = F.trim(c.cast("string"))
    # a full ISO-8601 date, alone or with a time and a zone; its written calendar date counts,
    # whatever the zone or the session's; anything else -> null
    return F.when(s.rlike(ISO_DATE), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def _row_key(df: DataFrame):
    """Row-order key when the input has none: unique, ascending within a file split."""
    return F.monotonically_increasing_id()


def _with_columns_if_missing(df: DataFrame, defaults: dict) -> DataFrame:
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast("string"))
    return df


def _with_defaults(df: DataFrame) -> DataFrame:
    return _with_columns_if_missing(df, {"governador_edicao": K.NAO_IDENTIFICADO, "orgao": None,
                                         "cargo_assinante": None, "estado": None, "tipo_ato": None})


def _signer(df: DataFrame) -> DataFrame:
    return df.withColumns({"autoridade_assinante": blank_to("cargo_assinante", K.SEM_IDENTIFICACAO),
                           "autoria_ato": C.autoria_ato("cargo_assinante")})


def _representative(df: DataFrame, accent_blind: bool) -> DataFrame:
    # three projections (each name depends on the previous one); the cleaned text is never blank,
    # so the name and origin rules need no second blank check
    df = df.withColumn("governador_edicao", C.governador_limpo("governador_edicao"))
    df = df.withColumn("representante_governo", C.representante_de_limpo("governador_edicao"))
    df = df.withColumn("origem_representante",
                       C.origem_de_limpo("governador_edicao", "representante_governo", accent_blind))
    return df.withColumn("representante_origem",
                         C.representante_origem("representante_governo", "origem_representante"))


def _people_and_signers(df: DataFrame, accent_blind: bool = False) -> DataFrame:
    df = _with_defaults(df).withColumn("pessoa", F.col("nome_normalizado"))
    return _representative(_signer(df), accent_blind)


SIGNER_LABELS = ["autoridade_assinante", "autoria_ato"]
REPRESENTATIVE_LABELS = ["governador_edicao", "representante_governo", "origem_representante", "representante_origem"]


def value_dictionary(df: DataFrame, accent_blind: bool = False) -> DataFrame:
    """One row per distinct raw ``governador_edicao`` and ``cargo_assinante`` (``campo``, ``valor``)
    with the labels that follow from it; null is a value like any other.

    Each task ships its distinct values only.  The result is written under the checkpoint directory,
    so that a later predicate on a label reads the small table and cannot be rewritten into one on
    the raw text of every row, and so that its size is known when a join with it is planned.
    """
    raw = ("governador_edicao", "cargo_assinante")
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in raw])
    values = _with_defaults(df).select(F.explode(pairs).alias("p")).select("p.campo", "p.valor").distinct()
    values = _representative(_signer(values.select("*", *[F.col("valor").alias(c) for c in raw])), accent_blind)
    return materialize(values.select("campo", "valor", *SIGNER_LABELS, *REPRESENTATIVE_LABELS), "values")


def clean_movements_by_value(mov: DataFrame, accent_blind: bool = False) -> DataFrame:
    """``clean_movements`` with the labels looked up in a :func:`value_dictionary` of ``mov``.

    Same rows and columns.  A predicate on a label (representative, authorship) is pushed to the
    dictionary and reaches the rows through the join on the raw value.  The dictionary is broadcast
    where its written size is below ``spark.sql.autoBroadcastJoinThreshold``; beyond that the join is
    an ordinary one, in which a hot value is split by the skew join.
    """
    df = _dated(_with_defaults(mov)).withColumn("pessoa", F.col("nome_normalizado"))
    values = value_dictionary(mov, accent_blind)

    def lookup(rows: DataFrame, campo: str, labels: list[str]) -> DataFrame:
        side = values.filter(F.col("campo") == campo).select(F.col("valor").alias("__valor"), *labels)
        key = F.col("__raw").cast("string")
        rows = rows.withColumn("__raw", F.col(campo)).drop(*labels)
        return rows.join(side, key.eqNullSafe(F.col("__valor")), "left").drop("__raw", "__valor")

    df = lookup(lookup(df, "cargo_assinante", SIGNER_LABELS), "governador_edicao", REPRESENTATIVE_LABELS)
    return df.select(*MOV_COLUMNS)


def _dated(mov: DataFrame) -> DataFrame:
    df = mov if "mov_id" in mov.columns else mov.withColumn("mov_id", _row_key(mov))
    d = parse_date(df, "data_publicacao")
    return df.withColumns({"data_movimentacao": d, "ano": F.year(d)})


def clean_movements(mov: DataFrame, accent_blind: bool = False) -> DataFrame:
    """Movements with derived columns: pessoa, data_movimentacao, ano, autoridade_assinante,
    autoria_ato, governador_edicao (cleaned), representante_governo, origem_representante,
    representante_origem.  ``mov_id`` is kept as the row-order key when present."""
    return _people_and_signers(_dated(mov), accent_blind).select(*MOV_COLUMNS)


def clean_returns(ret: DataFrame, null_as: bool = True, accent_blind: bool = False) -> DataFrame:
    """Returns with the movement columns plus mudou_cargo, mudou_orgao, tempo_cluster and the
    event state ``estado_N``.  Missing change flags read as ``null_as`` (a CSV gap is truthy)."""
    df = ret if "mov_id" in ret.columns else ret.withColumn("mov_id", _row_key(ret))
    df = _with_columns_if_missing(df, {"mudou_cargo_desde_exoneracao": None,
                                       "mudou_orgao_desde_exoneracao": None,
                                       "dias_desde_exoneracao": None, "data_exoneracao_anterior": None})
    if "tipo_ato" not in df.columns:
        df = df.withColumn("tipo_ato", F.lit(K.NOMEACAO))
    d = parse_date(df, "data_publicacao")
    df = df.withColumns({"data_nomeacao": d, "data_exoneracao": parse_date(df, "data_exoneracao_anterior"),
                         "ano": F.year(d)})
    df = _people_and_signers(df, accent_blind)

    def flag_type(name):
        t = df.schema[name].dataType
        return "boolean" if isinstance(t, T.BooleanType) else (
            "string" if isinstance(t, (T.StringType, T.NullType)) else "number")

    dias = F.col("dias_desde_exoneracao").cast("double")
    df = df.withColumns({
        "mudou_cargo": C.norm_bool("mudou_cargo_desde_exoneracao", flag_type("mudou_cargo_desde_exoneracao"), null_as),
        "mudou_orgao": C.norm_bool("mudou_orgao_desde_exoneracao", flag_type("mudou_orgao_desde_exoneracao"), null_as),
        "tempo_cluster": C.tempo_cluster(dias),
        "dias_desde_exoneracao": F.when(~F.isnan(dias), dias).cast("int"),
    })
    df = df.withColumn("estado_N", C.estado_evento("tempo_cluster", "mudou_cargo", "mudou_orgao"))
    return df.select(*RET_COLUMNS)
