"""Literal cases of the checklist, and laws."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators import claims, cluster, components, graph, match
from graphlens.sources import bibliography


def test_ghost_keep_grid(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    papers = spark.createDataFrame([(10, 0), (11, 0), (12, 1), (13, 1)], "id long, is_stub int")
    edges = spark.createDataFrame([(1, 11), (11, 1), (1, 12), (1, 13), (13, 2), (10, 12)], "citing_id long, cited_id long")
    got = {r["id"]: (r["degree"], r["kind"]) for r in graph.ghost_keep(edges, nodes, papers).collect()}
    assert got == {11: (1, "missing-data"), 13: (2, "pending")}


def test_greedy_cover_prefers_most_needs(spark):
    rows = [(1, "enrich_metadata_oa", "oa", "abstract"), (1, "enrich_metadata_oa", "oa", "venue"), (1, "enrich_metadata_ncbi", "ncbi", "abstract"), (2, "enrich_metadata_ncbi", "ncbi", "abstract")]
    needs = spark.createDataFrame(rows, "paper_id long, endpoint string, service string, field string")
    got = sorted((r["paper_id"], r["endpoint"]) for r in claims.route(needs).collect())
    assert got == [(1, "enrich_metadata_oa"), (2, "enrich_metadata_ncbi")]


def test_provider_budget_counts_calls(spark):
    needs = spark.createDataFrame([(i, "enrich_biblio_crossref", "crossref", "volume") for i in range(50)], "paper_id long, endpoint string, service string, field string")
    assert claims.route(needs, {"crossref": 1}).count() == 20


def test_blocking_windows(spark):
    rows = [(1, "claimed", "2024-01-01 11:30:00"), (2, "claimed", "2024-01-01 09:00:00"), (3, "failed", "2023-12-01 00:00:00"), (4, "failed", "2023-01-01 00:00:00"), (5, "succeeded", "2020-01-01 00:00:00")]
    a = spark.createDataFrame([(p, "oa", "year", s, t, p) for p, s, t in rows], "paper_id long, service string, field string, status string, claimed_at string, attempt_id long")
    ids = lambda **kw: sorted(r["paper_id"] for r in claims.blocking(a, "2024-01-01 12:00:00", **kw).collect())
    assert ids() == [1, 3, 5] and ids(reader_rule=False) == [1, 2, 3, 5]


def test_keywords_with_categories(spark):
    tags = spark.createDataFrame([(1, "fox", "species"), (1, "den", None), (1, "fox", "species")], "paper_id long, tag string, category string")
    assert bibliography.keywords(tags).first()["keywords"] == ["den", "fox"]
    assert bibliography.keywords(tags, prefixes=True).first()["keywords"] == ["den", "species:fox"]


def test_cuts_of_a_balanced_tree():
    """Eight points, halves joined at 8, quarters at 4, pairs at 1."""
    edges = [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0), (6, 7, 1.0), (1, 2, 4.0), (5, 6, 4.0), (3, 4, 8.0)]
    h = cluster.Hierarchy(8, edges, 2)
    names = lambda xs: [list(dict.fromkeys(xs)).index(x) for x in xs]
    assert names(h.frontier(1 / 6)) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert names(h.frontier(1 / 2)) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert [c for c, _ in h.shelves()] == [2]
    leaf = h.select("leaf")
    assert len(leaf) == 4 and len(set(h.labels(leaf))) == 4


def test_match_priority_and_single_count(spark):
    probes = spark.createDataFrame([(0, "a", "s", None), (1, None, "s", None), (2, None, None, None)], "idx long, doi string, s2_id string, oa_id string")
    papers = spark.createDataFrame([(5, "a", "s", None), (6, "b", "t", None)], "id long, doi string, s2_id string, oa_id string")
    assert sorted(map(tuple, match.multi_key_match(probes, papers).collect())) == [(0, 5, "doi"), (1, 5, "s2_id")]


def test_title_keywords(spark):
    df = spark.createDataFrame([("The <i>E. coli</i> and <scp>RecA</scp> of <i>e. coli</i>",)], "t string")
    assert df.select(X.title_keywords(F.col("t"))).first()[0] == ["E. coli", "RecA"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=12, unique=True))
def test_alias_roots_are_idempotent(spark, losers):
    a = spark.createDataFrame([(x, x - 1 if x % 3 else max(0, x - 3)) for x in losers], "loser_id long, winner_id long")
    roots = components.alias_roots(a)
    again = components.alias_roots(roots.withColumnRenamed("root_id", "winner_id"))
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, again.collect()))
    assert not {r["root_id"] for r in roots.collect()} & set(losers)


def test_number_rows_is_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = components.number_rows(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))
