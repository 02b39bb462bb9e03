"""Upkeep rules that the oracles don't reach."""

from pyspark.sql import functions as F

from graphlens.operators import cluster, maintenance, resolve


def test_status_stamp_keeps_the_first_change(spark):
    schema = "id long, editorial_status string, editorial_status_at timestamp"
    before = spark.createDataFrame([(1, None, None), (2, "retracted", None), (3, None, None)], schema)
    before = before.withColumn("editorial_status_at", F.when(F.col("id") == 2, F.to_timestamp(F.lit("2020-01-01"))))
    after = spark.createDataFrame([(1, "retracted", None), (2, "retracted", None), (3, None, None)], schema)
    got = {r["id"]: str(r["editorial_status_at"])[:4] for r in maintenance.status_stamp(before, after, "2024-01-02 00:00:00").collect()}
    assert got == {1: "2024", 2: "2020", 3: "None"}


def test_conflict_log_feeds_the_resolver(spark):
    papers = spark.createDataFrame([(1,)], "id long")
    log = spark.createDataFrame([(1, "title", "A title", "B title", "crossref", 1), (1, "doi", "x", "y", "crossref", 1)], "paper_id long, field string, existing_value string, proposed_value string, proposed_source string, discovered_at int")
    rows = maintenance.conflict_observations(papers, log)
    assert rows.count() == 2
    assert resolve.resolve_fields(rows).first()["value"] == "B title"


def test_settle_titles_with_and_without_own_ids(spark):
    items = spark.createDataFrame([(9, "Deep learning of graphs", None, "s9", None)], "paper_id long, title string, doi string, s2_id string, oa_id string")
    works = spark.createDataFrame([(1, "Deep learning of graphs!", "10.1/x", None, "W1")], "id long, title string, doi string, s2_id string, oa_id string")
    assert maintenance.settle_titles(items, works, True).first().asDict() == {"paper_id": 9, "status": "succeeded", "doi": "10.1/x", "s2_id": "s9", "oa_id": "W1"}
    assert maintenance.settle_titles(items, works, False).first()["s2_id"] is None


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 20.0), (3.0, 40.0)], "a double, b double")
    assert abs(maintenance.spearman(df, "a", "b").first()["rho"] - 1) < 1e-9


def test_size_sweep_over_one_tree():
    edges = [(i, i + 1, 1.0) for i in range(9) if i != 4] + [(4, 5, 10.0)]
    counts = dict(cluster.size_sweep(10, edges, [2, 5, 6]))
    assert counts[5] == 2 and counts[6] <= 1
    assert cluster.target_sizes(10, edges, 2, 2)


def test_rewiring_keeps_the_ends(spark):
    pairs = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1000).alias("b"))
    new = maintenance.rewired(pairs)
    assert new.count() == 500 and new.join(pairs, ["a", "b"]).count() < 100
    assert new.agg(F.sum("b")).first()[0] == pairs.agg(F.sum("b")).first()[0]


def test_absorbing_noise_leaves_none(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((30, 2)) * 0.2, rng.standard_normal((30, 2)) * 0.2 + 6, rng.uniform(-3, 9, (10, 2))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node_id long, vec array<double>")
    got = [r["cluster_id"] for r in cluster.hdbscan(v, 4, 8, noise="absorb")[0].orderBy("node_id").collect()]
    assert set(got) == {0, 1} and len(set(got[:30])) == len(set(got[30:60])) == 1


def test_lowest_pass():
    h = cluster.Hierarchy(5, [(0, 1, 1.0), (1, 2, 5.0), (2, 3, 2.0), (3, 4, 3.0)], 2)
    assert h._lowest_pass([0, -1, -1, -1, 1], [(0, 1, 1.0), (1, 2, 5.0), (2, 3, 2.0), (3, 4, 3.0)]) == [0, 0, 1, 1, 1]


def test_marks_and_release(spark):
    from graphlens.operators import claims

    a = spark.createDataFrame([(1, "oa", "year", "claimed", "2024-01-01 00:00:00", 5), (2, "oa", "year", "failed", "2024-01-01 00:00:00", 6)], "paper_id long, service string, field string, status string, claimed_at string, attempt_id long")
    keys = a.where("paper_id = 1").select("paper_id", "service", "field")
    assert claims.mark(a, keys, "released", "x").count() == 1
    out = claims.mark(a, keys, "succeeded", "2024-01-01 00:10:00")
    assert claims.current_state(out, "2024-01-01 00:20:00").where("paper_id = 1").first()["status"] == "succeeded"


def test_bundles_and_recipes(spark, sf_dir, tmp_path):
    import pytest

    from graphlens.plans import planner
    from graphlens.plans.views import Corpus
    from graphlens.sources import records

    c = Corpus(spark, sf_dir)
    v = c.table("embeddings").select((F.col("vec_id") + 1).alias("node_id"), F.col("embedding").alias("vec"))
    m = records.subset(c.papers, c.edges, v, F.col("year") < 2000, str(tmp_path / "s"))
    assert m["year_max"] < 2000 and m["nodes"] > 0
    records.backup({"edges": c.edges}, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy" / "edges")).count() == c.edges.count()
    r = planner.algorithms()
    steps = [{"id": "mutual-knn", "params": {"k": 3}}]
    assert planner.load_recipe(planner.save_recipe(steps), r) == steps
    with pytest.raises(ValueError):
        planner.load_recipe(planner.save_recipe([{"id": "none", "params": {}}]), r)
