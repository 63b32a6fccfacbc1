"""Collects the (query, SQL) pairs of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "search_hit_inventory"


def _modules() -> list:
    from .plans import index_queries, retrieval_queries, scalar_queries

    return [scalar_queries, retrieval_queries, index_queries]


def queries() -> dict[str, Callable]:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
