"""Named queries: a Spark callable, the SURVEY rows it covers and, if any, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``needs`` names fixture CTEs."""
    from hazardlake.plans.fixtures import CTES

    def keep(fn):
        text = None
        if sql is not None:
            head = ", ".join(f"{n} AS ({CTES[n]})" for n in needs)
            body = sql.strip()
            if body.startswith(","):
                text = f"WITH RECURSIVE {head}{body}" if head else f"WITH {body[1:]}"
            else:
                text = f"WITH {head} {body}" if head else body
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, tuple(ids.split()), fn, text)
        return fn

    return keep
