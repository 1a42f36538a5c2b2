"""The queries of the engine and their reference SQL: importing the modules registers them."""

from __future__ import annotations

from setloom.operators import corpus, features, graph, library, probe, screening, series, signal  # noqa: F401
from setloom.plans import collage, paths, planner, sets  # noqa: F401
from setloom.registry import ORACLES, QUERIES
from setloom.sources import tables  # noqa: F401
from setloom.streaming import player, sessions  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
