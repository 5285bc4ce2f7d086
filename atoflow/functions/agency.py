"""Agency text normalisation: display label and grouping key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import col_of, ustrip


def orgao_rotulo(orgao: Column | str) -> Column:
    """Display label: collapse whitespace, ' - ' around hyphens, no space around '/'; '' when missing."""
    o = ustrip(col_of(orgao))
    missing = o.isNull() | (o == F.lit("")) | F.lower(o).isin(*K.ORGAO_NULOS)
    r = F.regexp_replace(o, r"(?U)\s+", " ")
    r = F.regexp_replace(r, r"(?U)\s*-\s*", " - ")
    r = ustrip(F.regexp_replace(r, r"(?U)\s*/\s*", "/"))
    return F.when(missing, F.lit("")).otherwise(r)


def orgao_chave(rotulo: Column | str) -> Column:
    """Grouping key from a label: lower case, hyphens dropped, whitespace collapsed."""
    k = F.lower(col_of(rotulo))
    k = F.regexp_replace(k, r"(?U)\s*-\s*", " ")
    return ustrip(F.regexp_replace(k, r"(?U)\s+", " "))


def orgao_utilizavel(orgao: Column | str) -> Column:
    """True exactly when ``orgao_chave(orgao_rotulo(orgao))`` is non-empty: the text is present,
    not a null spelling, and holds something besides whitespace and hyphens (which the label
    keeps and the key removes).  One cheap test, so a filter needs no label/key regexes."""
    o = ustrip(col_of(orgao))
    return ~(o.isNull() | F.lower(o).isin(*K.ORGAO_NULOS) | o.rlike(r"(?U)^[\s-]*$"))
