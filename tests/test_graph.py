"""Flow, bridges, diffusion, clustering, alignment, metrics, labels, layouts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.operators import cluster, graph, labels, layout, metrics, vectors


def lab(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "node_id long, cluster_id int")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "citing_id long, cited_id long")


def test_flow(spark):
    f = graph.cluster_flow(edges(spark, [(0, 2), (1, 3), (2, 4), (4, 4), (5, 0)]), lab(spark, [0, 0, 1, 1, 2, -1]))
    assert sorted(map(tuple, f.collect())) == [(0, 1, 2), (1, 2, 1), (2, 2, 1)]


def test_bridge_count(spark):
    two, three = lab(spark, [0, 0, 0, 1, 1, 1]), lab(spark, [0, 0, 1, 1, 2, 2])
    assert graph.bridge_pair_count(three, two).first()[0] == 1
    assert graph.bridge_pair_count(two, lab(spark, [0] * 6)).first()[0] == 0


def test_absorption_on_a_path(spark):
    tree = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "i long, j long, w double")
    want = [0, 0, 0, 0, 1, 1, 1, 1]
    start = [0, 0, 0, -1, -1, 1, 1, 1]
    got = [r["cluster_id"] for r in graph.absorb(lab(spark, start), tree).orderBy("node_id").collect()]
    assert got == want
    adj = {i: [] for i in range(8)}
    for i in range(7):
        adj[i].append((i + 1, 1.0))
        adj[i + 1].append((i, 1.0))
    assert cluster.absorb_along(start, adj) == want


def test_diffusion_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 3))
    pairs = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (1, 1)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, vec array<double>")
    got = np.array([r["vec"] for r in graph.diffuse(v, edges(spark, pairs), 0.3, 4).orderBy("node_id").collect()])
    a = np.zeros((6, 6))
    for i, j in pairs:
        if i != j:
            a[i, j] = a[j, i] = 1
    deg = a.sum(1, keepdims=True)
    now = x.copy()
    for _ in range(4):
        now = 0.7 * x + 0.3 * np.divide(a @ now, deg, out=np.zeros_like(x), where=deg > 0)
    assert np.allclose(got, now)
    assert np.allclose(got[5], 0.7 * x[5])


def blobs():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.standard_normal((50, 3)) * 0.3 + c for c in ((0, 0, 0), (8, 0, 0), (0, 8, 0))])


def test_hdbscan_finds_blobs(spark):
    x = blobs()
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, vec array<double>")
    got, h, tree = cluster.hdbscan(v, 5, 10)
    assert tree.count() == len(x) - 1
    out = np.array([r["cluster_id"] for r in got.orderBy("node_id").collect()])
    assert sorted(set(out) - {-1}) == [0, 1, 2]
    for k in range(3):
        part = out[50 * k : 50 * k + 50]
        assert len(set(part) - {-1}) == 1
    levels = cluster.ladder(h, [(r["i"], r["j"], r["w"]) for r in tree.collect()])
    assert levels and all(-1 not in level for level in levels)
    # weight of the tree: plain Prim over mutual reachability
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5].astype(np.float32).astype(float)
    m = np.maximum(np.maximum(d.astype(np.float32).astype(float), core[:, None]), core[None])
    seen, best, total = np.zeros(len(x), bool), np.full(len(x), np.inf), 0.0
    best[0] = 0
    for _ in range(len(x)):
        i = int(np.where(seen, np.inf, best).argmin())
        seen[i], total = True, total + best[i]
        best = np.where(seen, best, np.minimum(best, m[i]))
    assert tree.agg(F.sum("w")).first()[0] == pytest.approx(total, rel=1e-9)


def test_reachability_tree_beyond_the_lists(spark, monkeypatch):
    rng = np.random.default_rng(9)
    parts = [rng.standard_normal((40, 3)) * 0.1 + c for c in ((0, 0, 0), (9, 0, 0), (0, 7, 0), (0, 0, 30))]
    x = np.concatenate([*parts, np.repeat([[3.0, 3.0, 3.0]], 30, 0), np.round(rng.standard_normal((40, 3)))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5].astype(np.float32).astype(float)
    m = np.maximum(np.maximum(d.astype(np.float32).astype(float), core[:, None]), core[None])
    name, want = list(range(len(x))), set()
    for w, i, j in sorted((m[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if name[i] != name[j]:
            want.add((i, j, w))
            name = [name[i] if k == name[j] else k for k in name]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, vec array<double>")
    asked, plain = [], cluster._lightest_out
    monkeypatch.setattr(cluster, "_lightest_out", lambda base, state, block: asked.append(state.where("open").count()) or plain(base, state, block))
    got = {(r["i"], r["j"], r["w"]) for r in cluster.reachability_tree(v, 5, block=64).collect()}
    assert got == want  # ties by ids, so there is one such tree
    assert asked and sum(asked) < 2 * len(x)  # few nodes were held against all others


def test_closest_pairs_with_copies_gaps_and_far_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((60, 4)), np.repeat(rng.standard_normal((1, 4)), 25, 0), 1e6 + rng.standard_normal((40, 4))])
    ids = rng.permutation(len(x)) * 7
    rows = [(int(i), r.tolist()) for i, r in zip(ids, x)] + [(5000, None), (5001, [0.0, float("nan"), 0.0, 0.0])]
    v = spark.createDataFrame(rows, "node_id long, vec array<double>")
    pairs = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).cumsum()[-1])), *sorted((int(ids[i]), int(ids[j])))) for i in range(len(x)) for j in range(i))
    n = len(rows) * (len(rows) - 1) // 2
    monkeypatch.setattr(vectors, "knn", None)  # no ordering of all pairs
    for blocks in (1, 5):
        monkeypatch.setattr(vectors, "block_count", lambda n, blocks=blocks: blocks)
        for density in (0.0, 0.01, 0.03, 0.2, 1.0):
            got = sorted((r["dist"], r["a"], r["b"]) for r in vectors.closest_pairs(v, density).collect())
            assert got == pairs[: int(density * n + 0.5)]


def test_repulsion_of_many_points_in_bounded_strips():
    import time
    import tracemalloc

    rng, n = np.random.default_rng(2), 3000
    pos = rng.standard_normal((n, 3)) * 30
    pos[7] = pos[2900]  # coincident: kicked apart, both finite
    draw = np.random.default_rng(1).random

    def plain(rows):
        gap = pos[rows, None] - pos[None]
        square = (gap * gap).sum(2)
        square[square < 1e-9] = np.inf
        return (gap * (5.0 / square)[..., None]).sum(1)

    began = time.perf_counter()
    want = np.concatenate([plain(slice(s, s + 500)) for s in range(0, n, 500)])
    slow = time.perf_counter() - began
    tracemalloc.start()
    began = time.perf_counter()
    got = layout._repulsion(pos, 5.0, draw)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    others = np.setdiff1d(np.arange(n), [7, 2900])
    assert np.allclose(got[others], want[others], rtol=1e-9, atol=1e-9) and np.isfinite(got).all()
    assert np.abs(got[[7, 2900]] - want[[7, 2900]]).sum(1).min() > 1000
    assert peak < 8e6 and took < slow


def test_displacement_finds_the_moved_node(spark):
    cube = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    moved = [(i, -y * 2, x * 2, z * 2 + (1.5 if i == 3 else 0)) for i, x, y, z in cube]
    schema = "node_id long, x double, y double, z double"
    d, corr = vectors.displacement(spark.createDataFrame(cube, schema), spark.createDataFrame(moved, schema))
    top = d.orderBy(F.desc("dist")).collect()
    assert top[0]["node_id"] == 3 and top[0]["dist"] > 2 * top[1]["dist"] and corr > 0.9


def test_horn_recovers_a_rotation():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 3))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    q = q * np.sign(np.linalg.det(q))
    rot, scale, ca, cb, corr = vectors.horn(a, a @ q.T * 3 + 1)
    assert np.allclose((a - ca) @ (rot * scale).T + cb, a @ q.T * 3 + 1) and corr == pytest.approx(1)


def test_metrics(spark):
    a, b = lab(spark, [0, 0, 1, 1, 2, 2]), lab(spark, [0, 0, 1, 2, 2, 2])
    assert metrics.adjusted_rand(a, a).first()[0] == 1
    assert metrics.adjusted_rand(lab(spark, [0, 0, 0]), lab(spark, [0, 0, 0])).first()[0] == 1
    assert metrics.normalised_mutual_information(a, a).first()[0] == pytest.approx(1)
    assert metrics.adjusted_mutual_information(a, a) == pytest.approx(1)
    got = metrics.matched_jaccard(a, b)
    assert got[0] == (0, 1.0) and got[2][0] == 2 and got[2][1] == pytest.approx(2 / 3)
    assert metrics.matched_jaccard(lab(spark, [0, 1, 1] + [2] * 7), lab(spark, [0, 1, 1] + [2] * 7), 3) == {2: (2, 1.0)}


def test_assignment_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    for r, c in ((3, 3), (2, 5), (5, 2), (4, 4)):
        w = rng.random((r, c))
        got = metrics.assign(w)
        mine = sum(w[i, j] for i, j in enumerate(got) if j >= 0)
        if r <= c:
            best = max(sum(w[i, p[i]] for i in range(r)) for p in itertools.permutations(range(c), r))
        else:
            best = max(sum(w[p[j], j] for j in range(c)) for p in itertools.permutations(range(r), c))
        assert mine == pytest.approx(best)


def test_bootstrap_of_a_fixed_partition(spark):
    ref = lab(spark, [i % 3 for i in range(30)])
    table, macro = metrics.bootstrap(ref, lambda s: ref.join(s, "node_id", "left_semi"), rounds=3)
    assert macro == 1 and set(table["class"]) == {"stable"}


def test_latin_hypercube_and_plateaus():
    pts = metrics.latin_hypercube({"a": (0, 1), "b": (1, 100)}, 8, 7, ("b",))
    assert pts == metrics.latin_hypercube({"a": (0, 1), "b": (1, 100)}, 8, 7, ("b",))
    assert sorted(int(p["a"] * 8) for p in pts) == list(range(8))
    assert metrics.plateaus([(2, 8), (3, 8), (4, 5), (5, 5), (6, 5), (7, 3)]) == {3: 7, 5: 5, 8: 3}


def test_labels(spark):
    t = spark.createDataFrame([(0, 0, "quantum gravity waves"), (1, 0, "quantum gravity theory"), (2, 1, "frog biology pond"), (3, 1, "frog ecology pond")], "node_id long, cluster_id int, text string")
    got = {(r["cluster_id"], r["rank"]): r["term"] for r in labels.class_tfidf(t).collect()}
    assert {got[0, 1], got[0, 2]} == {"gravity", "quantum"} and {got[1, 1], got[1, 2]} == {"frog", "pond"}
    assert {r["cluster_id"] for r in labels.key_phrases(t).collect()} == {0, 1}
    assert labels.diverse([("a b", 1.0), ("a c", 0.95), ("d", 0.75)], 2) == ["a b", "d"]


def test_layouts(spark):
    pos = layout.force_directed(5, np.array([[0, 1], [1, 2]]), rounds=20)
    assert pos.shape == (5, 3) and np.isfinite(pos).all()
    p = layout.stress(3, np.array([[0, 1], [1, 2]]))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert d[0, 2] == pytest.approx(24, rel=0.1) and d[0, 1] == pytest.approx(12, rel=0.1)
    h = layout.hop_matrix(4, np.array([[0, 1], [1, 2]]))
    assert h[0, 2] == 2 and math.isinf(h[0, 3])


def test_label_queries_read_whole_texts(spark, tmp_path):
    from graphlens import catalog

    texts = [(i, "early " * 100 + "lateword follows " * 200) for i in range(24)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "lateword" in {r["term"] for r in catalog.QUERIES["banded_terms"](spark, str(tmp_path)).collect()}
    assert all("lateword" in r["phrases"] for r in catalog.QUERIES["key_phrases"](spark, str(tmp_path)).collect())


def test_drawing_anchors_old_nodes_nearer_the_origin(spark):
    t = np.linspace(0, 1, 60)
    pos = layout.force_directed(60, np.zeros((0, 2), dtype=int), t=t)
    far = np.sqrt((pos * pos).sum(1))
    assert np.corrcoef(far, t)[0, 1] > 0.5 and far.max() <= layout.WALL * layout.RADIUS + 1e-6
    nodes = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "node_id long, t double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 900)], "a long, b long")
    got = np.array([tuple(r) for r in layout.drawing(nodes, edges).orderBy("node_id").collect()])
    assert np.allclose(got[:, 1:], layout.force_directed(60, np.array([[0, 1], [1, 2]]), t=t))


def test_rounds_of_a_large_drawing_are_dealt_out(spark, monkeypatch):
    rng, n = np.random.default_rng(4), 5000
    assert n > layout.LONE
    pos = rng.standard_normal((n, 3)) * 30
    pos[:300] *= 1e-3  # a clump
    pos[400] = pos[4900]  # coincident: kicked apart, both finite
    edges, t = rng.integers(0, n, (20000, 2)), np.arange(n) % 35 / 34
    want = layout._repulsion(pos, 4.0, np.random.default_rng(1).random)
    along = pos[edges[:, 1]] - pos[edges[:, 0]]
    along *= np.sqrt((along * along).sum(1, keepdims=True)) / 2
    np.add.at(want, edges[:, 0], along)
    np.add.at(want, edges[:, 1], -along)
    drawn = layout.force_directed(n, edges[np.lexsort(edges.T[::-1])], t, rounds=3)
    others = np.setdiff1d(np.arange(n), [400, 4900])
    monkeypatch.setattr(layout, "_repulsion", None)  # no round in one process
    for pairs in (900_000_000, 1_000_000):
        monkeypatch.setattr(layout, "PAIRS", pairs)
        got = layout.dealt(spark.sparkContext, edges, 1)(pos, 2.0, 0)
        assert (np.linalg.norm(got - want, axis=1) < 1e-6 * np.linalg.norm(want, axis=1))[others].all()
        assert np.abs(got[[400, 4900]] - want[[400, 4900]]).sum(1).min() > 1000 and np.isfinite(got).all()
    nodes = spark.createDataFrame([(i * 3, float(x)) for i, x in enumerate(t)], "node_id long, t double")
    links = spark.createDataFrame((edges * 3).tolist() + [[0, 1]], "a long, b long")
    got = layout.drawing(nodes, links, rounds=3).orderBy("node_id").toPandas()
    assert got["node_id"].tolist() == list(range(0, 3 * n, 3)) and np.allclose(got[["x", "y", "z"]], drawn, atol=1e-3)
