"""Citation graph: resolution of edges, degrees, ghosts, flow, bridges, diffusion, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.components import cut, iterate_until_stable


def canonical_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with both ends resolved one alias level."""
    a, b = (aliases.select(F.col("loser_id").alias(f"l{i}"), F.col("winner_id").alias(f"w{i}")) for i in (1, 2))
    out = edges.join(a, F.col("citing_id") == F.col("l1"), "left").join(b, F.col("cited_id") == F.col("l2"), "left")
    return out.select(F.coalesce("w1", "citing_id").alias("citing_id"), F.coalesce("w2", "cited_id").alias("cited_id")).distinct()


def node_set(papers: DataFrame) -> DataFrame:
    """Papers that are neither rejected, stubs nor tombstoned, with title and abstract."""
    return papers.where("is_rejected = 0 and is_stub = 0 and tombstone = 0 and title is not null and abstract is not null")


def top_cited(papers: DataFrame, edges: DataFrame, aliases: DataFrame, n: int = 20) -> DataFrame:
    """Most cited papers of the node set over canonical edges."""
    deg = canonical_edges(edges, aliases).where("citing_id <> cited_id").groupBy(F.col("cited_id").alias("id")).agg(F.count("*").alias("cited_by"))
    return node_set(papers).join(deg, "id").select("id", "year", "cited_by").orderBy(F.desc("cited_by"), "id").limit(n)


def within(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Edges with both ends in the node set."""
    n = nodes.select(F.col(node_id).alias("__n"))
    return edges.join(n, F.col("citing_id") == F.col("__n"), "left_semi").join(n, F.col("cited_id") == F.col("__n"), "left_semi")


def import_edges(raw: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Directed edges ``(a, b)`` once per unordered pair, first by ``seq``; and counts of what was dropped."""
    bad = (F.col("a") < 0) | (F.col("b") < 0) | (F.col("a") >= n) | (F.col("b") >= n)
    kept = raw.where(~bad & (F.col("a") != F.col("b"))).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    once = kept.groupBy("lo", "hi").agg(F.min(F.struct("seq", "a", "b")).alias("e")).select("e.a", "e.b")
    dropped = raw.agg(F.count_if(bad).alias("out_of_range"), F.count_if(~bad & (F.col("a") == F.col("b"))).alias("self_loops"))
    return once, dropped


def pending_degree(pending: DataFrame) -> DataFrame:
    """``(deg, n)``: cited endpoints by their number of distinct citing papers."""
    per = pending.where("cited_doi is not null").groupBy("cited_doi").agg(F.countDistinct("citing_doi").alias("deg"))
    return per.groupBy("deg").agg(F.count("*").alias("n"))


def ghost_keep(edges: DataFrame, nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """``(id, degree, kind)`` of papers outside the node set with enough partners inside it.

    Distinct partners in either direction: stubs with two or more are pending,
    others with one or more are missing data; the rest is dropped.
    """
    inside = nodes.select(F.col("id").alias("__n"))
    both = edges.select(F.col("citing_id").alias("g"), F.col("cited_id").alias("p")).unionAll(edges.select("cited_id", "citing_id"))
    pairs = both.join(inside, F.col("p") == F.col("__n"), "left_semi").join(inside, F.col("g") == F.col("__n"), "left_anti").distinct()
    deg = pairs.groupBy(F.col("g").alias("id")).agg(F.count("*").alias("degree"))
    kind = F.when((F.col("is_stub") == 1) & (F.col("degree") >= 2), "pending").when((F.col("is_stub") == 0) & (F.col("degree") >= 1), "missing-data")
    return deg.join(papers.select("id", "is_stub"), "id").select("id", "degree", kind.alias("kind")).where("kind is not null")


def resolve_endpoints(pending: DataFrame, papers: DataFrame) -> DataFrame:
    """``(id, citing_id, cited_id)``: pending edges with the paper each end resolves to alone, else null."""
    from graphlens.operators.match import multi_key_match

    out = pending
    for side in ("citing", "cited"):
        cols = [c for c in ("doi", "s2_id", "oa_id") if f"{side}_{c}" in pending.columns]
        probe = pending.select("id", *(F.col(f"{side}_{c}").alias(c) for c in cols)).withColumnRenamed("id", "idx")
        hits = multi_key_match(probe, papers, tuple(cols)).groupBy("probe").agg(F.count("*").alias("n"), F.min("paper").alias(f"{side}_id"))
        out = out.join(hits.where("n = 1").select(F.col("probe").alias("id"), f"{side}_id"), "id", "left")
    return out.select("id", "citing_id", "cited_id")


def promote(pending: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends both resolved to distinct papers, and the pending rows that stay."""
    r = resolve_endpoints(pending, papers)
    done = r.where("citing_id is not null and cited_id is not null")
    return done.where("citing_id <> cited_id").select("citing_id", "cited_id").distinct(), pending.join(done, "id", "left_anti")


def ingest_edges(records: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New citation records as edges, and those left pending.

    Unlike a promotion a self-citation stays pending, as does an end that
    several papers match.
    """
    r = resolve_endpoints(records, papers)
    done = r.where("citing_id is not null and cited_id is not null and citing_id <> cited_id")
    return done.select("citing_id", "cited_id").distinct(), records.join(done, "id", "left_anti")


def backfill_dois(pending: DataFrame, papers: DataFrame) -> DataFrame:
    """Pending rows with missing DOIs filled from the papers with the same id in the other scheme."""
    out = pending
    for side in ("citing", "cited"):
        known = papers.where("doi is not null and s2_id is not null").groupBy(F.col("s2_id").alias(f"{side}_s2_id")).agg(F.min("doi").alias("__doi"))
        out = out.join(known, f"{side}_s2_id", "left").withColumn(f"{side}_doi", F.coalesce(f"{side}_doi", "__doi")).drop("__doi")
    return out.select(pending.columns)


def cluster_flow(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(src, dst, n)``: citations from cluster to cluster; noise ends are left out."""
    a, b = (labels.select(F.col("node_id").alias(f"n{i}"), F.col("cluster_id").alias(c)) for i, c in ((1, "src"), (2, "dst")))
    joined = edges.join(a, F.col("citing_id") == F.col("n1")).join(b, F.col("cited_id") == F.col("n2"))
    return joined.where("src >= 0 and dst >= 0").groupBy("src", "dst").agg(F.count("*").alias("n"))


def flow_degrees(flow: DataFrame) -> DataFrame:
    """``(cluster_id, out_n, in_n, intra_n)`` of a flow table."""
    both = flow.select(F.col("src").alias("cluster_id"), F.when(F.col("src") != F.col("dst"), F.col("n")).alias("o"), F.lit(None).cast("long").alias("i"), F.when(F.col("src") == F.col("dst"), F.col("n")).alias("s"))
    other = flow.select("dst", F.lit(None).cast("long"), F.when(F.col("src") != F.col("dst"), F.col("n")), F.lit(None).cast("long"))
    zero = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return both.unionAll(other).groupBy("cluster_id").agg(zero("o", "out_n"), zero("i", "in_n"), zero("s", "intra_n"))


def bridges(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """``(cluster_id, members, span, dominant, boundary)`` of fine clusters over coarse ones.

    A bridge spans two or more coarse clusters; noise counts as one of them.
    """
    pairs = fine.where("cluster_id >= 0").join(coarse.select("node_id", F.col("cluster_id").alias("parent")), "node_id")
    counts = pairs.groupBy("cluster_id", "parent").agg(F.count("*").alias("n"))
    g = counts.groupBy("cluster_id").agg(F.sum("n").alias("members"), F.count("*").alias("span"), F.max("n").alias("top"))
    share = F.col("top") / F.col("members")
    return g.select("cluster_id", "members", "span", share.alias("dominant"), (1 - share).alias("boundary"))


def bridge_pair_count(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """One row: fine clusters whose members lie in two or more coarse clusters, noise left out."""
    pairs = fine.where("cluster_id >= 0").join(coarse.where("cluster_id >= 0").select("node_id", F.col("cluster_id").alias("parent")), "node_id")
    spans = pairs.groupBy("cluster_id").agg(F.countDistinct("parent").alias("span"))
    return spans.agg(F.count_if(F.col("span") >= 2).alias("bridges"))


def gate(fine: DataFrame, coarse: DataFrame, scores: DataFrame, least: float = 3) -> DataFrame:
    """``(cluster_id, is_bridge, scoreable)``: a bridge needs any parent scored, a core its dominant one.

    A bridge here spans two or more parents and has a dominant share under 0.8.
    """
    pairs = fine.where("cluster_id >= 0").join(coarse.select("node_id", F.col("cluster_id").alias("parent")), "node_id")
    counts = pairs.groupBy("cluster_id", "parent").agg(F.count("*").alias("n")).join(scores.select(F.col("cluster_id").alias("parent"), "score"), "parent", "left")
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    g = counts.groupBy("cluster_id").agg(
        F.count("*").alias("span"), (F.max("n") / F.sum("n")).alias("dominant"), F.bool_or(good).alias("any"),
        F.max(F.struct("n", (-F.col("parent")).alias("p"), good.alias("ok")))["ok"].alias("main"),
    )
    bridge = (F.col("span") >= 2) & (F.col("dominant") < 0.8)
    return g.select("cluster_id", bridge.alias("is_bridge"), F.when(bridge, F.col("any")).otherwise(F.col("main")).alias("scoreable"))


def _symmetric(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("citing_id").alias("a"), F.col("cited_id").alias("b"))
    return both.unionAll(both.select("b", "a")).where("a <> b").distinct()


def _scale(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(k))


def neighbour_mean(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(a, mean)``: mean vector of every node's neighbours, summed dimension by dimension."""
    flat = pairs.join(vectors.select(F.col("node_id").alias("b"), "vec"), "b").select("a", F.posexplode("vec").alias("i", "x"))
    cells = flat.groupBy("a", "i").agg(F.avg("x").alias("x"))
    return cells.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("mean"))


def diffuse(vectors: DataFrame, edges: DataFrame, alpha: float = 0.3, steps: int = 4, ghosts: DataFrame | None = None) -> DataFrame:
    """Anchored diffusion: X <- (1 - alpha) X0 + alpha D^-1 A X, ``steps`` times.

    Edges are undirected, distinct and without loops. A real node without a
    neighbour keeps (1 - alpha) X0. Ghosts have no anchor: they start at the
    mean of their embedded neighbours and follow the mean alone.
    """
    alpha, steps = min(max(alpha, 0.0), 0.999), min(max(int(steps), 0), 50)
    start = vectors.select("node_id", F.col("vec").cast("array<double>").alias("vec")).withColumn("ghost", F.lit(False))
    pairs = _symmetric(edges)
    if ghosts is not None:
        own = ghosts.select("node_id").join(start, "node_id", "left_anti")
        first = neighbour_mean(pairs, start).join(own, F.col("a") == F.col("node_id")).select("node_id", F.col("mean").alias("vec"), F.lit(True).alias("ghost"))
        start = start.unionAll(first)
    start = cut(start)
    pairs = cut(pairs.join(start.select(F.col("node_id").alias("a")), "a", "left_semi").join(start.select(F.col("node_id").alias("b")), "b", "left_semi").select("a", "b"))
    now = start
    for _ in range(steps):
        mean = neighbour_mean(pairs, now)
        base = start.join(mean, F.col("node_id") == F.col("a"), "left")
        anchored = F.when(F.col("mean").isNull(), _scale(F.col("vec"), 1 - alpha)).otherwise(F.zip_with("vec", "mean", lambda x, m: x * (1 - alpha) + m * alpha))
        now = cut(base.select("node_id", F.when(F.col("ghost"), F.coalesce("mean", "vec")).otherwise(anchored).alias("vec"), "ghost"))
    return now.select("node_id", "vec")


def hops(edges: DataFrame, seeds: DataFrame, limit: int = 64) -> DataFrame:
    """``(node_id, hops)``: undirected distance from the nearest seed, layer by layer."""
    pairs = cut(_symmetric(edges))
    seen = cut(seeds.select(F.col("node_id"), F.lit(0).alias("hops")).distinct())
    layer = seen
    for h in range(1, limit + 1):
        new = layer.join(pairs, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        layer = cut(new.select("node_id", F.lit(h).alias("hops")))
        if layer.isEmpty():
            break
        seen = cut(seen.unionAll(layer))
    return seen


def graph_neighbours(edges: DataFrame, nodes: DataFrame, k: int = 15, limit: int = 4) -> DataFrame:
    """``(node_id, neighbour, hops)``: each node first, then others by hop distance, smallest id first, k in all.

    A node with fewer than k within ``limit`` hops keeps fewer; nothing is padded at random.
    """
    pairs = cut(_symmetric(edges))
    seen = cut(nodes.select("node_id", F.col("node_id").alias("neighbour"), F.lit(0).alias("hops")))
    layer, w = seen, Window.partitionBy("node_id").orderBy("hops", "neighbour")
    for h in range(1, limit + 1):
        new = layer.join(pairs, F.col("neighbour") == F.col("a")).select("node_id", F.col("b").alias("neighbour")).distinct()
        new = new.join(seen, ["node_id", "neighbour"], "left_anti").withColumn("hops", F.lit(h))
        layer = cut(new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n"))
        if layer.isEmpty():
            break
        seen = cut(seen.unionByName(layer))
    return seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def absorb(labels: DataFrame, tree: DataFrame) -> DataFrame:
    """Noise nodes take the label at the least path length over tree edges ``(i, j, w)``; ties: smallest label."""
    pairs = cut(tree.select(F.col("i").alias("a"), F.col("j").alias("b"), "w").unionAll(tree.select("j", "i", "w")))
    start = labels.select("node_id", F.when(F.col("cluster_id") >= 0, F.struct(F.lit(0.0).alias("d"), F.col("cluster_id").alias("c"))).alias("best"))

    def relax(df: DataFrame) -> DataFrame:
        reach = df.where("best is not null").join(pairs, F.col("node_id") == F.col("a"))
        offers = reach.select(F.col("b").alias("node_id"), F.struct((F.col("best.d") + F.col("w")).alias("d"), F.col("best.c").alias("c")).alias("best"))
        return df.unionByName(offers).groupBy("node_id").agg(F.min("best").alias("best"))

    done = iterate_until_stable(start, relax, lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("node_id", "best.d", "best.c"))).first()), limit=10_000)
    return done.select("node_id", F.coalesce("best.c", F.lit(-1)).alias("cluster_id"))


def expand_to_ghosts(labels: DataFrame, ghosts: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ghosts take the label of their nearest labelled neighbour; no geometry: of the smallest neighbour."""
    from graphlens.operators.vectors import euclid

    g = ghosts.select(F.col("node_id").alias("g")).join(_symmetric(edges), F.col("g") == F.col("a")).select("g", "b")
    g = g.join(labels.select(F.col("node_id").alias("b"), "cluster_id"), "b")
    g = g.join(vectors.select(F.col("node_id").alias("b"), F.col("vec").alias("vb")), "b", "left").join(vectors.select(F.col("node_id").alias("g"), F.col("vec").alias("vg")), "g", "left")
    d = F.coalesce(euclid(F.col("vg"), F.col("vb")), F.lit(float("inf")))
    near = g.groupBy("g").agg(F.min(F.struct(d.alias("d"), "b", "cluster_id"))["cluster_id"].alias("cluster_id"))
    rest = ghosts.select(F.col("node_id").alias("g")).join(near, "g", "left").select(F.col("g").alias("node_id"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    return labels.select("node_id", "cluster_id").unionAll(rest)


def bridged_pairs(edges: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``(a, b, ghosts)``, a < b: real nodes that share a ghost neighbour and no edge of their own."""
    pairs = _symmetric(edges)
    g = ghosts.select(F.col("node_id").alias("g")).distinct()
    arms = pairs.join(g, F.col("a") == F.col("g")).select("g", F.col("b").alias("r")).join(g.select(F.col("g").alias("x")), F.col("r") == F.col("x"), "left_anti")
    wedge = arms.select("g", F.col("r").alias("a")).join(arms.select("g", F.col("r").alias("b")), "g").where("a < b")
    return wedge.groupBy("a", "b").agg(F.count("*").alias("ghosts")).join(pairs, ["a", "b"], "left_anti")


def dirichlet(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: edges with both vectors, and the sum of squared distances along them."""
    a, b = (vectors.select(F.col("node_id").alias(n), F.col("vec").alias(f"v{n}")) for n in ("citing_id", "cited_id"))
    sq = F.aggregate(F.zip_with("vciting_id", "vcited_id", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return edges.join(a, "citing_id").join(b, "cited_id").agg(F.count("*").alias("edges"), F.sum(sq).alias("energy"))


def union_edges(parts: list[DataFrame]) -> DataFrame:
    """Edges of several sources once, the provenance of the first part that has them."""
    tagged = [p.select("citing_id", "cited_id", F.lit(i).alias("seq"), "provenance") for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionAll, tagged)
    return rows.groupBy("citing_id", "cited_id").agg(F.min(F.struct("seq", "provenance"))["provenance"].alias("provenance"))
