"""Partition agreement, matching, stability and parameter sweeps.

Contingency tables and their sums are Spark aggregations; what reaches the
driver is the cluster-by-cluster table or less.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.text import rng32


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(ca, cb, n)`` of two labelings ``(node_id, cluster_id)``; -1 is an ordinary label here."""
    j = a.select("node_id", F.col("cluster_id").alias("ca")).join(b.select("node_id", F.col("cluster_id").alias("cb")), "node_id")
    return j.groupBy("ca", "cb").agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(table.groupBy(c).agg(F.sum("n").alias("n")) for c in ("ca", "cb"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``ari``: null for no nodes, 1 for trivial partitions."""
    t = contingency(a, b)
    pairs = lambda d, name: d.agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).alias(name), F.sum("n").alias(f"{name}_n"))
    ra, rb = _marginals(t)
    j = pairs(t, "s").crossJoin(pairs(ra, "p")).crossJoin(pairs(rb, "q"))  # one row each
    total = F.col("s_n") * (F.col("s_n") - 1) / 2
    expected = F.col("p") * F.col("q") / F.nullif(total, F.lit(0.0))
    top = (F.col("p") + F.col("q")) / 2
    value = F.when(F.coalesce(F.col("s_n"), F.lit(0)) == 0, None).when((total == 0) | (top == expected), 1.0).otherwise((F.col("s") - expected) / (top - expected))
    return j.select(value.cast("double").alias("ari"))


def information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``mi, ha, hb, n`` in natural logarithms."""
    t = contingency(a, b)
    ra, rb = _marginals(t)
    n = t.agg(F.sum("n").alias("total"))
    j = t.join(ra.withColumnRenamed("n", "na"), "ca").join(rb.withColumnRenamed("n", "nb"), "cb").crossJoin(n)
    mi = j.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda r, name: r.crossJoin(n).agg((-F.sum(F.col("n") / F.col("total") * F.log(F.col("n") / F.col("total")))).alias(name))
    return mi.crossJoin(entropy(ra, "ha")).crossJoin(entropy(rb, "hb")).crossJoin(n.withColumnRenamed("total", "n"))


def normalised_mutual_information(a: DataFrame, b: DataFrame, geometric: bool = False) -> DataFrame:
    """One row ``nmi``; zero denominators give 1 if both entropies are 0, else 0."""
    i = information(a, b)
    low = F.sqrt(F.col("ha") * F.col("hb")) if geometric else (F.col("ha") + F.col("hb")) / 2
    return i.select(F.when(low > 0, F.col("mi") / low).when((F.col("ha") <= 0) & (F.col("hb") <= 0), 1.0).otherwise(0.0).alias("nmi"))


def expected_information(rows: list[int], cols: list[int]) -> float:
    """Expected mutual information of random partitions with these sizes (hypergeometric)."""
    n, lg, out = sum(rows), math.lgamma, 0.0
    for (a, ka), (b, kb) in itertools.product(pd.Series(rows).value_counts().items(), pd.Series(cols).value_counts().items()):
        for x in range(max(1, a + b - n), min(a, b) + 1):
            p = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(x + 1) - lg(a - x + 1) - lg(b - x + 1) - lg(n - a - b + x + 1)
            out += ka * kb * x / n * math.log(n * x / (a * b)) * math.exp(p)
    return out


def adjusted_mutual_information(a: DataFrame, b: DataFrame) -> float:
    """AMI with the larger entropy as the norm; sizes of clusters come to the driver."""
    i = information(a, b).first()
    ra, rb = _marginals(contingency(a, b))
    e = expected_information([r["n"] for r in ra.collect()], [r["n"] for r in rb.collect()])
    low = max(i["ha"], i["hb"]) - e
    return 1.0 if abs(low) < 1e-15 else (i["mi"] - e) / low


def jaccard(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """``(ca, cb, n, jaccard)`` of overlapping clusters, noise left out on both sides."""
    t = contingency(ref.where("cluster_id >= 0"), cand.where("cluster_id >= 0"))
    size = lambda d, c, name: d.where("cluster_id >= 0").groupBy(F.col("cluster_id").alias(c)).agg(F.count("*").alias(name))
    j = t.join(size(ref, "ca", "na"), "ca").join(size(cand, "cb", "nb"), "cb")
    return j.select("ca", "cb", "n", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def best_jaccard(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """``(ca, cb, jaccard)``: best candidate of each reference cluster; candidates may repeat."""
    best = F.max(F.struct("jaccard", (-F.col("cb")).alias("c")))
    return jaccard(ref, cand).groupBy("ca").agg(best.alias("b")).select("ca", (-F.col("b.c")).alias("cb"), F.col("b.jaccard").alias("jaccard"))


def assign(weight: np.ndarray) -> list[int]:
    """Column of every row in a maximum-weight matching (shortest augmenting paths); -1 where none is left."""
    r, c = weight.shape
    n = max(r, c)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : r + 1, 1 : c + 1] = -weight
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            cur = cost[match[j0]] - u[match[j0]] - v
            better = ~used & (cur < least)
            least[better], way[better] = cur[better], j0
            j1 = int(np.where(used, np.inf, least)[1:].argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * r
    for j in range(1, c + 1):
        if 1 <= match[j] <= r:
            out[match[j] - 1] = j - 1
    return out


def matched_jaccard(ref: DataFrame, cand: DataFrame, min_members: int = 1) -> dict[int, tuple[int, float]]:
    """``{ref: (cand, jaccard)}`` of the best one-to-one matching; unmatched clusters score 0 with candidate -1."""
    sizes = {r["cluster_id"]: r["count"] for r in ref.where("cluster_id >= 0").groupBy("cluster_id").count().collect()}
    names = sorted(c for c, n in sizes.items() if n >= min_members)
    rows = [r for r in jaccard(ref, cand).collect() if r["ca"] in set(names)]
    cands = sorted({r["cb"] for r in rows})
    w = np.zeros((len(names), len(cands)))
    for r in rows:
        w[names.index(r["ca"]), cands.index(r["cb"])] = r["jaccard"]
    got = assign(w) if len(cands) and len(names) else [-1] * len(names)
    return {c: (cands[j], float(w[i, j])) if j >= 0 and w[i, j] > 0 else (-1, 0.0) for i, (c, j) in enumerate(zip(names, got))}


def retention(pre: DataFrame, post: DataFrame) -> DataFrame:
    """``(node_id, retention)``: share of a node's peers still with it; null for noise, 1 for a lone node."""
    t = pre.select("node_id", F.col("cluster_id").alias("ca")).join(post.select("node_id", F.col("cluster_id").alias("cb")), "node_id")
    both = t.groupBy("ca", "cb").agg(F.count("*").alias("same"))
    size = t.groupBy("ca").agg(F.count("*").alias("size"))
    r = F.when((F.col("ca") < 0) | (F.col("cb") < 0), None).when(F.col("size") == 1, 1.0).otherwise((F.col("same") - 1) / (F.col("size") - 1))
    return t.join(both, ["ca", "cb"]).join(size, "ca").select("node_id", r.alias("retention"))


def compare(pre: DataFrame, post: DataFrame) -> DataFrame:
    """``(cluster_id, size, retained, lost, biggest_share)`` of every earlier cluster."""
    t = contingency(pre.where("cluster_id >= 0"), post)
    g = t.groupBy(F.col("ca").alias("cluster_id")).agg(F.sum("n").alias("size"), F.max(F.when(F.col("cb") >= 0, F.col("n")).otherwise(0)).alias("retained"))
    return g.select("cluster_id", "size", "retained", (F.col("size") - F.col("retained")).alias("lost"), (F.col("retained") / F.col("size")).alias("biggest_share"))


def bootstrap(ref: DataFrame, cluster, rounds: int = 25, fraction: float = 0.5, min_members: int = 3, noise: str = "ignore", seed: int = 1) -> tuple[pd.DataFrame, float]:
    """Stability of clusters under resampling: per cluster the mean matched Jaccard, and their size-weighted mean.

    ``cluster(nodes) -> labels`` clusters a sample given as a DataFrame of
    node_id. Classes: stable from 0.85, doubtful from 0.60. ``penalise`` scales
    each score by the share of the sample that is not noise.
    """
    n, scores = ref.count(), {}
    size = max(2, math.floor(n * fraction + 0.5))
    for b in range(rounds):
        sample = ref.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed * 1000 + b))).limit(size)
        labels = cluster(sample)
        keep = 1.0
        if noise == "penalise":
            keep = 1 - labels.where("cluster_id < 0").count() / size
        for c, (_, j) in matched_jaccard(ref.join(sample, "node_id", "left_semi"), labels, min_members).items():
            scores.setdefault(c, []).append(j * keep)
    sizes = {r["cluster_id"]: r["count"] for r in ref.where("cluster_id >= 0").groupBy("cluster_id").count().collect()}
    rows = [(c, sizes[c], float(np.mean(s)), "stable" if np.mean(s) >= 0.85 else "doubtful" if np.mean(s) >= 0.6 else "unstable") for c, s in sorted(scores.items())]
    out = pd.DataFrame(rows, columns=["cluster_id", "size", "jaccard", "class"])
    return out, float(np.average(out["jaccard"], weights=out["size"])) if len(out) else float("nan")


def grid(params: dict[str, list]) -> list[dict]:
    """All combinations of parameter values."""
    return [dict(zip(params, x)) for x in itertools.product(*params.values())]


def latin_hypercube(ranges: dict[str, tuple[float, float]], count: int, seed: int, logarithmic: tuple[str, ...] = ()) -> list[dict]:
    """``count`` points, one in each of ``count`` equal slices of every range."""
    draw, out = rng32(seed), [{} for _ in range(count)]
    for name, (lo, hi) in ranges.items():
        slots = list(range(count))
        for i in range(count - 1, 0, -1):
            j = int(draw() * (i + 1))
            slots[i], slots[j] = slots[j], slots[i]
        for i, s in enumerate(slots):
            x = (s + draw()) / count
            out[i][name] = math.exp(math.log(lo) + x * (math.log(hi) - math.log(lo))) if name in logarithmic else lo + x * (hi - lo)
    return out


def plateaus(counts: list[tuple[int, int]]) -> dict[int, int]:
    """Middle size of the widest run of equal cluster counts, by count; earlier runs win ties."""
    best: dict[int, list[int]] = {}
    for count, run in itertools.groupby(sorted(counts), key=lambda x: x[1]):
        sizes = [s for s, _ in run]
        if len(sizes) > len(best.get(count, [])):
            best[count] = sizes
    return {c: s[len(s) // 2] for c, s in sorted(best.items())}


def target_score(count: int, low: int, high: int) -> float:
    """Closeness of a cluster count to the middle of a range."""
    return 1 / (1 + abs(count - (low + high) / 2))


def dim_sweep(labels: dict[tuple[int, int], DataFrame], threshold: float = 0.9) -> dict:
    """Agreement of dimensions across seeds: ``{(d1, d2): (mean, sd)}`` and whether the mean passes."""
    dims, seeds = sorted({d for d, _ in labels}), sorted({s for _, s in labels})
    out = {}
    for d1, d2 in itertools.combinations(dims, 2):
        got = [adjusted_rand(labels[d1, s], labels[d2, s]).first()[0] for s in seeds]
        out[d1, d2] = (float(np.mean(got)), float(np.std(got)), bool(np.mean(got) > threshold))
    return out


#: Scorers by name: labels (and what they need) to a number.
SCORERS = {
    "numClusters": lambda labels, **_: labels.where("cluster_id >= 0").select("cluster_id").distinct().count(),
    "richness": lambda labels, **_: 1 - labels.where("cluster_id < 0").count() / max(1, labels.count()),
    "stability": lambda labels, cluster, **kw: bootstrap(labels, cluster, **kw)[1],
}
