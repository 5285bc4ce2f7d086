"""Display labels: short representative names and period texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .classify import representante
from .text import col_of, first_last_words, split_once, ustrip


def rotulo_representante_curto(gov: Column | str) -> Column:
    """First and last word of the representative name."""
    return first_last_words(representante(gov))


def rotulo_governo_curto(gov: Column | str) -> Column:
    """'First Last - role' (role kept verbatim); text without ' - ' is returned stripped."""
    g = ustrip(F.coalesce(F.nullif(col_of(gov), F.lit("")), F.lit(K.NAO_IDENTIFICADO)))
    nome, cargo = split_once(g, " - ")
    return F.when(F.instr(g, " - ") > 0, F.concat(first_last_words(nome), F.lit(" - "), cargo)).otherwise(g)


def periodo_anos(anos: Column | str) -> Column:
    """Text for a set of years: 'Y', 'A-B' when contiguous, else 'A, B, D'; none -> 'sem período'.

    ``anos`` is an array column (e.g. ``collect_set(ano)``); nulls are ignored.
    """
    a = F.array_sort(F.array_distinct(F.filter(col_of(anos), lambda x: x.isNotNull())))
    n = F.size(a)
    lo, hi = F.element_at(a, 1), F.element_at(a, -1)
    return (F.when(n == 0, F.lit(K.SEM_PERIODO))
            .when(n == 1, lo.cast("string"))
            .when((hi - lo + 1) == n, F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))
            .otherwise(F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")))


def periodo_min_max(anos: Column | str) -> Column:
    """Plain 'min-max' text (gaps ignored); one year -> 'Y'; none -> 'sem periodo'."""
    a = F.filter(col_of(anos), lambda x: x.isNotNull())
    lo, hi = F.array_min(a), F.array_max(a)
    return (F.when(F.size(a) == 0, F.lit(K.SEM_PERIODO_RESUMO))
            .when(lo == hi, lo.cast("string"))
            .otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))))
