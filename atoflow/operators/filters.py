"""The dashboard slice (six optional predicates) and the valid choices for each filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleanse import clean_movements, clean_movements_by_value


@dataclass(frozen=True)
class Filters:
    """Optional predicates; an empty tuple / None means 'no filter' for that column."""

    estado: str | None = None
    anos: tuple[int, ...] = ()
    representantes: tuple[str, ...] = ()
    orgaos: tuple[str, ...] = ()
    autorias: tuple[str, ...] = ()
    tipos: tuple[str, ...] = ()


def slice_movements(mov_c: DataFrame, f: Filters) -> DataFrame:
    """Apply the predicates; Catalyst pushes them into the scan (and prunes ``estado`` partitions
    when the table is written partitioned by state).

    A year set also adds the date range it implies on ``data_movimentacao``: ``year(date) IN``
    cannot reach a parquet reader, but the range is unwrapped through the date cast and pushed,
    so row groups outside the selected years are skipped.  The result is unchanged.
    """
    out = mov_c
    if f.estado:
        out = out.filter(F.col("estado") == F.lit(f.estado))
    if f.anos and "data_movimentacao" in mov_c.columns:
        lo, hi = min(f.anos), max(f.anos)
        out = out.filter((F.col("data_movimentacao") >= F.make_date(F.lit(lo), F.lit(1), F.lit(1)))
                         & (F.col("data_movimentacao") < F.make_date(F.lit(hi + 1), F.lit(1), F.lit(1))))
    for column, values in (("ano", f.anos), ("representante_origem", f.representantes),
                           ("orgao", f.orgaos), ("autoria_ato", f.autorias), ("tipo_ato", f.tipos)):
        if values:
            out = out.filter(F.col(column).isin(*values))
    return out


def slice_raw(mov: DataFrame, f: Filters, accent_blind: bool = False) -> DataFrame:
    """The cleaned slice of raw movements: equals ``slice_movements(clean_movements(mov), f)``.

    Where a label is filtered (representative, authorship), the distinct raw values of the state's
    rows are classified once and the predicate is applied to them, not to the label text of each row.
    """
    if f.estado and "estado" in mov.columns:
        mov = mov.filter(F.col("estado") == F.lit(f.estado))
    by_label = f.representantes or f.autorias
    return slice_movements((clean_movements_by_value if by_label else clean_movements)(mov, accent_blind), f)


def filter_choices(mov_c: DataFrame, ret_c: DataFrame) -> DataFrame:
    """(filtro, valor) for every filter: states from the movements; years, raw agencies and
    representatives from both tables; distinct, non-null, sorted by (filtro, valor).

    Each table is read once: its filter columns are unpivoted with ``explode`` and the union is
    de-duplicated (partial aggregation first, so each task ships only its distinct pairs)."""
    def unpivot(df: DataFrame, kinds: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("filtro"), F.col(k).cast("string").alias("valor")) for k in kinds])
        return df.select(F.explode(pairs).alias("p")).select("p.filtro", "p.valor")

    both = ["ano", "orgao", "representante_origem"]
    allv = unpivot(mov_c, ["estado", *both]).unionByName(unpivot(ret_c, both))
    return allv.filter(F.col("valor").isNotNull()).distinct().orderBy("filtro", "valor")


def representative_choices(mov_c: DataFrame, estado: str | None, selected: list[str] | tuple = ()):
    """Options for the representative filter within a state, and the still-valid selections."""
    base = mov_c if not estado else mov_c.filter(F.col("estado") == F.lit(estado))
    options = (base.select(F.col("representante_origem").cast("string").alias("valor"))
                   .filter(F.col("valor").isNotNull()).distinct().orderBy("valor"))
    valid = options.filter(F.col("valor").isin(*selected)) if selected else options.limit(0)
    return options, valid
