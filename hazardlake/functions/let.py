"""Name an intermediate value inside one expression, so that it is computed once.

The optimizer merges neighbouring projections: a costly column that a lambda or a formula
reads would be copied into it and computed again per element or per use. A lambda variable
holds a value, not an expression, so binding one keeps the work at one evaluation per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def let_sql(value: str, name: str, body: str) -> str:
    """The same for expression text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"
