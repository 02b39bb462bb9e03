"""Module contracts and lanes: what runs after what, and registries of pluggable algorithms."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class CycleError(ValueError):
    """The dependencies hold a cycle or name something that nobody makes."""


@dataclass(frozen=True)
class Module:
    """A step: the names it needs, the names it makes, and how it runs."""

    name: str
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    run: Callable[..., Any] | None = None


def plan(modules: list[Module]) -> list[str]:
    """Names in an order in which everything needed is made before, by name among equals."""
    makers: dict[str, set[str]] = {}
    for m in modules:
        for p in m.produces:
            makers.setdefault(p, set()).add(m.name)
    needs = {m.name: {x for r in m.requires for x in makers.get(r, {f"?{r}"}) if x != m.name} for m in modules}
    return order(needs)


def order(needs: dict[str, set[str]]) -> list[str]:
    """Topological order of a dependency map."""
    left, out = {k: set(v) for k, v in needs.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v)
        if not ready:
            raise CycleError(f"cycle or missing maker among {sorted(left)}")
        out += ready
        for k in ready:
            del left[k]
        for v in left.values():
            v.difference_update(ready)
    return out


def run_lanes(lanes: dict[str, tuple[tuple[str, ...], Callable[..., Any]]]) -> dict[str, Any]:
    """Results of every lane ``name: (deps, f(*dep results))``; Spark runs what they declare lazily."""
    out: dict[str, Any] = {}
    for name in order({k: set(d) for k, (d, _) in lanes.items()}):
        deps, f = lanes[name]
        out[name] = f(*(out[d] for d in deps))
    return out


@dataclass
class Registry:
    """Algorithms by id with their default parameters and the values a sweep tries."""

    entries: dict[str, dict] = field(default_factory=dict)

    def add(self, id_: str, run: Callable, params: dict | None = None, sweep: dict[str, list] | None = None) -> None:
        """Register ``run(df, **params)``."""
        if id_ in self.entries:
            raise ValueError(f"two algorithms named {id_}")
        self.entries[id_] = {"run": run, "params": params or {}, "sweep": sweep or {}}

    def run(self, id_: str, *args, **params):
        """Run an algorithm with its defaults and ``params``; unknown parameters are an error."""
        e = self.entries[id_]
        unknown = set(params) - set(e["params"])
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return e["run"](*args, **{**e["params"], **params})


def check_labels(labels, nodes: int, noise: bool = True) -> None:
    """Errors unless there is a row a node and ids are contiguous from 0, with -1 only where noise may be."""
    from pyspark.sql import functions as F

    r = labels.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("u"), F.min("cluster_id").alias("lo"), F.max("cluster_id").alias("hi"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("k")).first()
    if r["n"] != nodes or r["u"] != nodes:
        raise ValueError("not one row a node")
    if r["lo"] is not None and (r["lo"] < -1 or (r["lo"] < 0 and not noise) or r["k"] != r["hi"] + 1):
        raise ValueError("cluster ids are not contiguous from 0")


def check_vectors(vectors, d: int) -> None:
    """Errors unless every vector has ``d`` finite numbers."""
    from pyspark.sql import functions as F

    bad = vectors.where(F.col("vec").isNull() | (F.size("vec") != d) | F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    if not bad.isEmpty():
        raise ValueError("vectors of another length, or with numbers that are none")


def save_recipe(steps: list[dict]) -> str:
    """Steps ``{"id", "params"}`` as JSON with sorted keys."""
    return json.dumps({"version": 1, "steps": steps}, sort_keys=True)


def load_recipe(text: str, registry: Registry) -> list[dict]:
    """Steps of a recipe; an unknown algorithm or parameter is an error."""
    steps = json.loads(text)["steps"]
    for s in steps:
        if s["id"] not in registry.entries or set(s["params"]) - set(registry.entries[s["id"]]["params"]):
            raise ValueError(f"unknown step {s}")
    return steps


def algorithms() -> Registry:
    """The engine's clustering algorithms."""
    from graphlens.operators import cluster

    r = Registry()
    r.add("mutual-knn", cluster.mutual_knn, {"k": 5}, {"k": [3, 5, 8, 12]})
    r.add("connected-components", cluster.knn_components, {"k": 8, "as_coded": False}, {"k": [5, 8, 12]})
    r.add("hdbscan", lambda v, **p: cluster.hdbscan(v, **p)[0], {"min_samples": 5, "min_size": 5, "method": "eom", "epsilon": 0.0, "noise": "keep"}, {"min_size": [5, 10, 15, 25]})
    return r


def sweep(registry: Registry, id_: str, vectors, score: Callable) -> list[tuple[dict, float]]:
    """``(params, score)`` of every combination of an algorithm's sweep values, best first."""
    from graphlens.operators.metrics import grid

    out = [(p, float(score(registry.run(id_, vectors, **p)))) for p in grid(registry.entries[id_]["sweep"])]
    return sorted(out, key=lambda x: -x[1])
