"""Small helpers shared by the registered queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(col) -> Column:
    """Second-precise text of a timestamp, equal in both engines."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sql_iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def r(col, n: int = 6) -> Column:
    return F.round(col, n)


def joined(arr, sep: str = "|") -> Column:
    """Array as text."""
    return F.array_join(arr, sep)
