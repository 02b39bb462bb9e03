"""Components, compaction, merge plans, field resolution, author and title rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators import claims, components, graph, match, resolve


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_compaction_follows_chains(spark):
    papers = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    aliases = spark.createDataFrame([(2, 1), (3, 2)], "loser_id long, winner_id long")
    edges = spark.createDataFrame([(2, 4), (3, 4), (4, 2)], "citing_id long, cited_id long")
    counts = spark.createDataFrame([(2, "oa", 5)], "paper_id long, source string, cit_count long")
    out = components.compact(papers, edges, aliases, {"counts": (counts, ["source"], ["cit_count"])})
    assert rows(out["edges"]) == [(1, 4), (4, 1)]
    assert rows(out["papers"]) == [(1,), (4,)]
    assert rows(out["counts"].select("paper_id", "cit_count")) == [(1, 5)]
    dry = components.compact(papers, edges, aliases, dry_run=True)
    assert dry["deleted"] == 2 and rows(dry["edges"]) == rows(edges)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20))
def test_components_are_smallest_reachable(spark, pairs):
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(a != b and n in (a, b) for a, b in pairs)}


def test_merge_winner_and_transplant(spark):
    m = spark.createDataFrame(
        [(1, 1, "d", None, None, None, None), (1, 2, "d", None, None, "t", 2001), (2, 5, "e", None, "W1", "t", None), (2, 6, None, "s", "W2", None, 1999)],
        "component long, id long, doi string, s2_id string, oa_id string, title string, year int",
    )
    plan = {r["component"]: r for r in resolve.merge_plan(m, ("title", "year")).collect()}
    assert plan[1]["winner"] == 2 and plan[1]["losers"] == [1]
    assert plan[2]["winner"] == 5 and plan[2]["s2_id"] == "s" and plan[2]["year"] == 1999 and plan[2]["conflicts"] == ["oa_id:W1:W2"]
    papers = m.drop("component").withColumn("tombstone", F.lit(0))
    merged, aliases = resolve.apply_merges(papers, resolve.merge_plan(m, ("title", "year")), ("title", "year"))
    got = {r["id"]: r for r in merged.collect()}
    assert got[6]["tombstone"] == 1 and got[6]["s2_id"] is None and got[5]["s2_id"] == "s"
    assert rows(aliases) == [(1, 2), (6, 5)]


def test_equal_trust_conflicts_and_trust_wins(spark):
    o = spark.createDataFrame(
        [(1, "title", "A", "openalex", None, 1), (1, "title", "B", "s2_live", None, 1), (2, "title", "A", "oa_x", None, 1), (2, "title", "B", "openalex", None, 1), (3, "title", " Hello   World ", "s2", None, 1), (3, "title", "hello world", "openalex", None, 1)],
        "paper_id long, field string, value string, source string, pub_type_hint string, observed_at int",
    )
    got = {r["paper_id"]: (r["value"], r["conflict"]) for r in resolve.resolve_fields(o).collect()}
    assert got[1] == ("A", False) and got[2] == ("A", True) and got[3][1] is False and got[3][0] == " Hello   World "


def test_author_rules():
    assert X.name_tokens("Smith, John") == ["smith", "john"]
    assert X.same_person("Smith, John", "J. Smith") and not X.same_person("Smith, John", "Doe, Jane")
    assert resolve.merge_author_lists([["J. Smith"], ["Smith, John", "Doe, Jane"]]) == ["Smith, John", "Doe, Jane"]
    assert resolve.merge_author_lists([["A One", "B Two"], ["C Three"]]) == ["A One", "B Two"]


@pytest.mark.parametrize(
    "raw,want",
    [("<scp>C</scp>ry<scp>1F</scp>-toxin", "Cry1F-toxin"), ("<sup>13</sup>C-Glucose", "13C-Glucose"), ("a &amp;#39;b&amp;#39;", "a 'b'"), ("The <i>E. coli</i> , strain", "The E. coli, strain"), (None, None),
     ("of<italic>Spodoptera</italic>(<bold>B</bold>t)", "of Spodoptera (Bt)"), ("<smallcaps>a</smallcaps>b <sans-serif>c</sans-serif><monospace>d</monospace>", "ab cd"),
     (">i<Bacillus>/i< kept <other>", ">i<Bacillus>/i< kept <other>"), ("  plain  as it is ", "  plain  as it is "), ("<mml:math>x</mml:math> <S>y</S>", "x y")],
)
def test_clean_title(raw, want):
    got = X.clean_title_py(raw)
    assert got == want
    assert X.clean_title_py(got) == got


@given(st.text(alphabet="ab /:.10DOI htps", max_size=30))
@settings(max_examples=30)
def test_clean_title_is_idempotent(t):
    once = X.clean_title_py(t)
    assert X.clean_title_py(once) == once


def test_title_entities(spark):
    raw = "<i>Wolbachia</i> <em>a, b</em> <scp>ABC</scp> <scp>CYP321A9</scp> <i>13</i> <italic>x</italic> <i>Spodoptera  <b>frugiperda</b></i>"
    assert X.title_keywords_py(raw) == ["Wolbachia", "Spodoptera frugiperda", "CYP321A9"]
    df = spark.createDataFrame([(raw,), ("&lt;i&gt;Bt toxin&lt;/i&gt;",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(X.title_keywords(F.col("t"))).collect()][1:] == [["Bt toxin"], [], []]


def test_names_keep_their_ends(spark):
    df = spark.createDataFrame([("A0 and 1B1 and  22 C2 2",)], "n string")
    assert df.select(X.split_names(F.col("n"))).first()[0] == ["A0", "1B1", "22 C2 2"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(X.ngrams(F.col("w"), 3)).collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_key_suffixes(spark):
    from graphlens.sources import bibliography

    got = [r[0] for r in spark.range(1, 31).orderBy("id").select(bibliography.key_suffix(F.col("id"))).collect()]
    assert got[:3] == ["", "a", "b"] and got[26:] == ["z", "z1", "z2", "z3"]


def test_doi_forms(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB",), ("doi:10.1/ab",), (" 10.1/aB ",), ("",), (None,)], "raw string")
    assert [r[0] for r in df.select(X.normalise_doi(F.col("raw"))).collect()] == ["10.1/ab", "10.1/ab", "10.1/ab", None, None]


def test_self_citation_goes_but_counts_as_done(spark):
    papers = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "id long, doi string, s2_id string, oa_id string")
    pending = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", "x")], "id long, citing_doi string, cited_doi string")
    done, left = graph.promote(pending, papers)
    assert rows(done) == [(1, 2)] and rows(left.select("id")) == [(3,)]


def test_greedy_cover_and_order():
    with pytest.raises(ValueError):
        claims.order_columns("id; drop", ["id"])
    assert len(claims.order_columns("id DESC, year", ["id", "year"])) == 2


def test_title_match(spark):
    papers = spark.createDataFrame([(1, "Deep learning of citation graphs"), (2, "Unrelated biology of frogs")], "id long, title string")
    probes = spark.createDataFrame([(9, "Deep Learning of Citation Graph"), (8, "Nothing like it")], "idx long, title string")
    assert [(r["probe"], r["paper"]) for r in match.title_match(probes, papers).collect()] == [(9, 1)]


def test_title_match_of_frequent_words(spark):
    rows = [(i, "Hot common title") for i in range(1500)] + [(2000 + i, f"frogs pond {i:05d} survey") for i in range(1200)] + [(9000, "frogs pond survey")]
    papers = spark.createDataFrame(rows, "id long, title string")
    probes = spark.createDataFrame([(1, "HOT common title!"), (2, "Hot common titles"), (3, "frogs pond survey"), (4, "frogs pond surveys"), (5, "nothing")], "idx long, title string")
    got = {r["probe"]: (r["paper"], r["ratio"]) for r in match.title_match(probes, papers).collect()}
    want = {}
    for r in probes.collect():
        t = r["title"].lower().strip("!")
        ratio, paper = max((X.ratio(t, x.lower()), -i) for i, x in rows)
        if ratio >= 0.85:
            want[r["idx"]] = (-paper, ratio)
    assert got == want and set(got) == {1, 2, 3, 4} and got[3][0] == got[4][0] == 9000
    one = match.title_match(probes.selectExpr("*", "2001 as year"), papers.selectExpr("*", "if(id < 1400, 2000, 2001) as year"), same_year=True)
    assert {r["probe"]: r["paper"] for r in one.collect()}[1] == 1400


def test_search_terms_and_grid():
    assert X.search_terms("(alpha OR beta) AND gamma NOT delta") == [["alpha", "gamma"], ["beta", "gamma"]]
    g = X.log_grid(1000)
    assert g[0] == 2 and g[-1] == 500 and g == sorted(set(g))
    assert X.clean_tex(r"M{\"u}ller {\ss} --- \'{e}") == "Müller ß — é"
