"""Imports every module that registers queries."""

from graphlens.plans import queries_core, queries_graph, queries_upkeep  # noqa: F401
from graphlens.registry import ORACLES, QUERIES  # noqa: F401
