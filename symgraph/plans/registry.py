"""All registered queries of the core."""

from __future__ import annotations

from symgraph.plans import data_queries, graph_queries

_MODULES = [graph_queries, data_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
