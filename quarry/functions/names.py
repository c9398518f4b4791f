"""Name normalisation shared by labels and items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trim_blanks(c: Column | str) -> Column:
    """The string without blanks and tabs at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(BLANKS))


def clean_name(c: Column | str) -> Column:
    """Trimmed, cut before the first dot, trimmed again; null if nothing is left."""
    return F.nullif(trim_blanks(F.substring_index(trim_blanks(c), ".", 1)), F.lit(""))


def clean_name_sql(c: str) -> str:
    """``clean_name`` as ANSI SQL text."""
    return f"nullif(trim(split_part(trim({c}, ' \t'), '.', 1), ' \t'), '')"
