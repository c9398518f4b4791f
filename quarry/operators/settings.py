"""Grids of settings and the names of their runs."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(**values: list) -> list[dict]:
    """Every combination of the values, the last name varying fastest."""
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


def run_name(parts: dict[str, Column], dashed: tuple[str, ...] = ()) -> Column:
    """``<name><value>`` for each part, joined by ``_``; dots become dashes in the ``dashed`` ones."""
    text = lambda k, c: F.replace(c.cast("string"), F.lit("."), F.lit("-")) if k in dashed else c.cast("string")
    return F.concat_ws("_", *[F.concat(F.lit(k), text(k, c)) for k, c in parts.items()])
