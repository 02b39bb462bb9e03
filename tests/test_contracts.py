"""Contracts, lanes and the remaining graph helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.operators import cluster, graph, labels, metrics, vectors
from graphlens.plans import planner, sql_surface
from graphlens.sources import records
from graphlens.streaming import ingest


def lab(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "node_id long, cluster_id int")


def test_label_and_vector_contracts(spark):
    planner.check_labels(lab(spark, [0, 1, -1]), 3)
    for bad, n, noise in (([0, 2], 2, True), ([0, -1], 2, False), ([0], 2, True)):
        with pytest.raises(ValueError):
            planner.check_labels(lab(spark, bad), n, noise)
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "node_id long, vec array<double>")
    with pytest.raises(ValueError):
        planner.check_vectors(v, 2)
    planner.check_vectors(v.where("node_id = 0"), 2)


def test_ghosts_take_the_nearest_label(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (10, [4.0, 4.0])], "node_id long, vec array<double>")
    e = spark.createDataFrame([(10, 0), (10, 1), (11, 1), (11, 0)], "citing_id long, cited_id long")
    got = graph.expand_to_ghosts(lab(spark, [3, 7]), spark.createDataFrame([(10,), (11,), (12,)], "node_id long"), e, v)
    assert {r["node_id"]: r["cluster_id"] for r in got.collect()} == {0: 3, 1: 7, 10: 7, 11: 3, 12: -1}


def test_clusters_inside_parents(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "node_id long, vec array<double>")
    got = cluster.within_parents(lab(spark, [0, 0, 0, 1, 1, -1]), v, lambda pdf: (pdf["node_id"] % 2).to_numpy())
    out = {r["node_id"]: r["cluster_id"] for r in got.collect()}
    assert out == {0: 0, 1: 1, 2: 0, 3: 3, 4: 2}


def test_dimension_sweep(spark):
    a, b = lab(spark, [0, 0, 1, 1]), lab(spark, [1, 1, 0, 0])
    assert metrics.dim_sweep({(50, 1): a, (50, 2): a, (100, 1): b, (100, 2): b}) == {(50, 100): (1.0, 0.0, True)}


def test_scorers_and_sweep(spark):
    labels_ = lab(spark, [0, 0, 1, -1])
    assert metrics.SCORERS["numClusters"](labels_) == 2 and metrics.SCORERS["richness"](labels_) == 0.75
    v = spark.createDataFrame([(i, [float(i // 4 * 50 + i)]) for i in range(12)], "node_id long, vec array<double>")
    r = planner.Registry()
    r.add("mutual", cluster.mutual_knn, {"k": 3}, {"k": [1, 3]})
    got = planner.sweep(r, "mutual", v, metrics.SCORERS["numClusters"])
    assert got[0][1] >= got[1][1] and {p["k"] for p, _ in got} == {1, 3}


def test_datasets_by_alias(spark):
    sql_surface.namespace_views(spark, {"mine": {"papers": spark.range(3)}, "other": {"papers": spark.range(2)}})
    assert sql_surface.search(spark, "select count(*) as n from mine_papers join other_papers using (id)")[0].first()["n"] == 2
    with pytest.raises(ValueError):
        sql_surface.namespace_views(spark, {"a b": {}})


def test_progress_listener(spark, tmp_path):
    spark.range(5).select(F.col("id").cast("string").alias("v")).write.json(str(tmp_path / "in"))
    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        q = ingest.read_stream(spark, str(tmp_path / "in"), "v string").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        import time

        for _ in range(50):
            if sum(seen.rows.values()) == 5:
                break
            time.sleep(0.2)
        assert sum(seen.rows.values()) == 5
    finally:
        spark.streams.removeListener(seen)


def test_edges_across_imports_and_marks(spark):
    raw = spark.createDataFrame([(0, 1, 1), (1, 0, 2), (2, 2, 3), (0, 9, 4)], "a long, b long, seq long")
    once, dropped = graph.import_edges(raw, 5)
    assert [tuple(r) for r in once.collect()] == [(0, 1)] and tuple(dropped.first()) == (1, 1)
    marks = records.present_marks(spark.createDataFrame([("x", "t", "")], "key string, title string, venue string"), ["title", "venue"], "key")
    assert {r["field"]: r["status"] for r in marks.collect()} == {"title": "succeeded", "venue": "failed"}


def test_alignment_by_component(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((10, 3))
    b = a @ np.linalg.qr(rng.standard_normal((3, 3)))[0]
    b[:5] = a[:5] * 2 + 1
    b[5:] = a[5:] * 3 - 2
    frame = lambda x: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "node_id long, x double, y double, z double")
    parts = spark.createDataFrame([(i, i // 5) for i in range(10)], "node_id long, component int")
    got = vectors.align_by_component(frame(a), frame(b), parts).orderBy("node_id").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], b)


def test_combined_labels(spark):
    phrases = spark.createDataFrame([(0, ["a", "b"]), (1, [])], "cluster_id int, phrases array<string>")
    terms = spark.createDataFrame([(1, "t", 1), (1, "u", 2)], "cluster_id int, term string, rank int")
    years = spark.createDataFrame([(2, 1990, 2000, 1995)], "cluster_id int, low int, high int, median int")
    assert {r["cluster_id"]: r["label"] for r in labels.combined_label(phrases, terms, years).collect()} == {0: "a, b", 1: "t, u", 2: "1990–2000"}
