"""Queries and their reference SQL, registered by the operator modules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setloom.sources.views import VIEWS, Views, duck_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement with the domain views that it names put before it, for an engine that has the tables only."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({duck_view(n)})" for n in needed)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.I):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if re.match(r"WITH\s", body, re.I) else f"WITH {head} {body}"


def query(name: str, oracle: str | None = None):
    """Registers a function of ``Views`` as a query, with the SQL that gives the same rows."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return register


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a statement over views and tables; ``oracle`` is its other engine's spelling where they differ."""
    query(name, oracle or sql)(lambda v: v.sql(sql))
