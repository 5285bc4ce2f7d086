"""Row classification rules: authorship, representative, origin, flags, time buckets, event state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import blank_to, col_of, split_once, ustrip

# Java regex: (?i) case-insensitive, (?U) Unicode classes so \b and \s follow Python 3 str rules.
RX_SECRETARIA = r"(?iU)^(?:Subsecret.rio|Secret.rio)(?:\b|\s+-)"
RX_GOVERNADOR = r"(?iU)^Governador(?:\b|\s+-)"


def autoria_ato(cargo: Column | str) -> Column:
    """Authorship class from the signatory title; the secretariat rule wins over the governor rule."""
    c = ustrip(F.coalesce(col_of(cargo), F.lit("")))
    return (F.when(c.rlike(RX_SECRETARIA), F.lit(K.AUTORIA_SECRETARIA))
            .when(c.rlike(RX_GOVERNADOR), F.lit(K.AUTORIA_GOVERNADOR))
            .otherwise(F.lit(K.AUTORIA_OUTRO)))


def governador_limpo(gov: Column | str) -> Column:
    return blank_to(gov, K.NAO_IDENTIFICADO)


def representante(gov: Column | str) -> Column:
    """Name before the first ' - ' (stripped, blank -> default); the whole stripped text otherwise."""
    g = ustrip(F.coalesce(F.nullif(col_of(gov), F.lit("")), F.lit(K.NAO_IDENTIFICADO)))
    head, _ = split_once(g, " - ")
    return F.when(F.instr(g, " - ") > 0, blank_to(head, K.NAO_IDENTIFICADO)).otherwise(g)


def representante_de_limpo(g: Column | str) -> Column:
    """``representante`` for an already cleaned (stripped, non-blank) ``governador_edicao``."""
    g = col_of(g)
    head = F.substring_index(g, " - ", 1)
    return F.when(F.instr(g, " - ") > 0, blank_to(head, K.NAO_IDENTIFICADO)).otherwise(g)


# accented letters of Portuguese and their plain forms (for the optional accent-blind lookup)
_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"


def fold_accents(c: Column | str) -> Column:
    return F.translate(col_of(c), _ACCENTED, _PLAIN)


def origem_de_limpo(g: Column | str, rep: Column | str, accent_blind: bool = False) -> Column:
    """``origem`` given the cleaned ``governador_edicao`` and its representative name.

    The dictionary keys are unaccented, so an accented name misses them (the analysed
    application's behaviour, the default); ``accent_blind=True`` folds accents before the lookup."""
    r = col_of(rep)
    key = fold_accents(r) if accent_blind else r
    return (F.when(r == F.lit(K.NAO_IDENTIFICADO), F.lit(K.NAO_IDENTIFICADO))
            .otherwise(F.coalesce(
                F.try_element_at(_origem_map(), key),
                F.when(col_of(g).contains(K.ACTING_MARKER), F.lit(K.ORIGEM_VICE)),
                F.lit(K.ORIGEM_EXECUTIVO))))


def _origem_map() -> Column:
    pairs = []
    for nome, origem in K.ORIGEM_POR_NOME.items():
        pairs += [F.lit(nome), F.lit(origem)]
    return F.create_map(*pairs)


def origem(gov: Column | str) -> Column:
    """Origin of the representative: fixed dictionary, then the acting-governor rule, then default."""
    nome = representante(gov)
    return (F.when(nome == F.lit(K.NAO_IDENTIFICADO), F.lit(K.NAO_IDENTIFICADO))
            .otherwise(F.coalesce(
                F.try_element_at(_origem_map(), nome),
                F.when(F.coalesce(col_of(gov), F.lit("")).contains(K.ACTING_MARKER), F.lit(K.ORIGEM_VICE)),
                F.lit(K.ORIGEM_EXECUTIVO))))


def representante_origem(rep: Column | str, orig: Column | str) -> Column:
    return F.concat(col_of(rep), F.lit(" ("), col_of(orig), F.lit(")"))


def norm_bool(c: Column | str, dtype: str = "string", null_as: bool = True) -> Column:
    """'sim' (any case, stripped) -> true, other strings false; missing -> ``null_as``
    (a CSV gap is NaN, and NaN is truthy)."""
    x = col_of(c)
    if dtype == "boolean":
        return F.coalesce(x, F.lit(null_as))
    if dtype in ("string",):
        return F.coalesce(F.lower(ustrip(x)) == F.lit("sim"), F.lit(null_as))
    return F.coalesce(x.cast("double") != F.lit(0.0), F.lit(null_as))


def tempo_cluster(dias: Column | str) -> Column:
    d = col_of(dias)
    return (F.when(d.isNull() | F.isnan(d.cast("double")), F.lit("desconhecido"))
            .when(d == 0, F.lit("imediato"))
            .when(d < K.TEMPO_CURTO_LT, F.lit("curto"))
            .when(d <= K.TEMPO_MEDIO_LE, F.lit("medio"))
            .otherwise(F.lit("longo")))


def estado_evento(tempo: Column | str, mudou_cargo: Column | str, mudou_orgao: Column | str) -> Column:
    """``N_{tempo}_{novo|mesmo}_cargo_{novo|mesmo}_orgao``."""
    cargo = F.when(col_of(mudou_cargo), F.lit("novo_cargo")).otherwise(F.lit("mesmo_cargo"))
    org = F.when(col_of(mudou_orgao), F.lit("novo_orgao")).otherwise(F.lit("mesmo_orgao"))
    return F.concat_ws("_", F.lit("N"), col_of(tempo), cargo, org)
