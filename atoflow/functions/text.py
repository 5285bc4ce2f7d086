"""String helpers with Python ``str`` semantics expressed as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() holds (Unicode
# whitespace plus the separators U+001C..U+001F); Spark's trim() removes only U+0020.  The set
# is derived from Python's own rule and handed to btrim (a character-set trim, no regex).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def blank_to(c: Column | str, default: str) -> Column:
    """``value.fillna('').astype(str).str.strip().replace('', default)``."""
    return F.coalesce(F.nullif(ustrip(c), F.lit("")), F.lit(default))


def ptbr_int(c: Column | str) -> Column:
    """Integer with '.' as the thousands separator (``f"{v:,}".replace(",", ".")``)."""
    return F.replace(F.format_number(col_of(c).cast("long"), 0), F.lit(","), F.lit("."))


def split_once(c: Column | str, sep: str) -> tuple[Column, Column]:
    """``s.split(sep, 1)``: (head, tail); tail is null when ``sep`` is absent."""
    s = col_of(c)
    pos = F.instr(s, sep)
    head = F.when(pos > 0, F.substring(s, F.lit(1), pos - 1)).otherwise(s)
    tail = F.when(pos > 0, F.substring(s, pos + len(sep), F.length(s)))
    return head, tail


def word_tokens(c: Column | str) -> Column:
    """``s.split()``: whitespace tokens without empty strings."""
    return F.filter(F.split(ustrip(c), r"(?U)\s+"), lambda t: t != F.lit(""))


def first_last_words(c: Column | str) -> Column:
    """'first last' when there are two or more tokens, else the input unchanged."""
    toks = word_tokens(c)
    return F.when(F.size(toks) >= 2,
                  F.concat(F.element_at(toks, 1), F.lit(" "), F.element_at(toks, -1))).otherwise(col_of(c))
