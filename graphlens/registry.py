"""Query registry: each query with, where SQL can express it, its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from graphlens.plans.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``; the oracle may name derived views."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return f

    return add
