"""Files in and out, the SQL surface, planning, streaming."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.plans import planner, sql_surface
from graphlens.sources import arrays, bibliography, records
from graphlens.streaming import ingest

RIS = "TY  - JOUR\nTI  - A title\nAU  - Smith, John\nAU  - Doe, Jane\nPY  - 2004/03\nDO  - https://doi.org/10.1234/AbC\nER  - \n\nTY  - BOOK\nTI  - B\nSN  - 123\nnoise\nER  - \n"
BIB = '@string{x = "y"}\n@article{k1, title = {A {Nested} title}, author = "Smith, John and M{\\"u}ller, K", year = 2004, pages = {1--9}, title = {second}}\n@comment{no}\n@book(k2, title={B})'


def test_ris(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    got = bibliography.ris_papers(bibliography.read_ris(spark, str(tmp_path))).collect()
    assert len(got) == 2
    assert got[0]["doi"] == "10.1234/abc" and got[0]["authors"] == ["Smith, John", "Doe, Jane"] and got[0]["year"] == 2004 and got[0]["pub_type"] == "article"
    assert got[1]["serial"] == "isbn:123"


def test_bib_and_round_trip(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    p = bibliography.bib_papers(bibliography.read_bib(spark, str(tmp_path)))
    got = p.collect()
    assert [r["citekey"] for r in got] == ["k1", "k2"]
    assert got[0]["title"] == "A Nested title" and got[0]["authors"] == ["Smith, John", "Müller, K"] and (got[0]["first_page"], got[0]["last_page"]) == ("1", "9")
    out = bibliography.to_bibtex(p.withColumn("id", F.monotonically_increasing_id()))
    bibliography.write_text(out, str(tmp_path / "out"))
    again = bibliography.bib_papers(bibliography.read_bib(spark, str(tmp_path / "out")))
    assert sorted(r["title"] for r in again.collect()) == ["A Nested title", "B"]
    ris = bibliography.to_ris(p.withColumn("id", F.monotonically_increasing_id())).collect()
    assert ris[0]["value"].startswith("TY  - JOUR\nTI  - A Nested title\nAU  - Smith, John\n") and ris[0]["value"].endswith("ER  - \n")


def test_citekey_collisions(spark):
    p = spark.createDataFrame([(1, None, "Alpha one", ["Smith, J"], 2001), (2, None, "Alpha two", ["Smith, K"], 2001), (3, "mine", "x", [], None)], "id long, citekey string, title string, authors array<string>, year int")
    assert [r["citekey"] for r in bibliography.citekeys(p).orderBy("id").collect()] == ["smith2001alpha", "smith2001alphaa", "mine"]


def test_npy(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    v = arrays.read_npy(spark, str(tmp_path / "m.npy"))
    assert np.array_equal(np.array([r["vec"] for r in v.orderBy("row").collect()]), m)
    rows = spark.createDataFrame([(2, 0), (0, 1)], "row long, place long")
    (tmp_path / "s.npy").write_bytes(arrays.slice_npy(v, rows).first()["content"])
    assert np.array_equal(np.load(tmp_path / "s.npy"), m[[2, 0]])
    assert arrays.to_bytes(m) == (tmp_path / "m.npy").read_bytes()
    with pytest.raises(ValueError):
        arrays.read_header(b"nonsense")


def test_json_lines_and_works(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"source":"oa","doi":"10.1/x","year":2001,"unknown":1}\nnot json\n')
    got = records.read_json_lines(spark, str(tmp_path), records.PAPER_RECORD).collect()
    assert len(got) == 1 and got[0]["doi"] == "10.1/x"
    work = {"id": "https://x.org/w12", "doi": "https://doi.org/10.1/A", "title": "T <i>x</i>", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "referenced_works": ["https://x.org/W3"], "publication_year": 2001}
    w = records.parse_works(spark.createDataFrame([(json.dumps(work),)], "value string"))
    r = w.first()
    assert r["oa_id"] == "W12" and r["doi"] == "10.1/a" and r["abstract"] == "a b a" and r["references"] == ["W3"]
    assert [tuple(x) for x in records.citation_edges(w, "oa_id").collect()] == [("W12", "W3")]
    msg = {"DOI": "10.1/B", "title": ["T"], "page": "1-9", "author": [{"family": "A", "given": "B"}], "issued": {"date-parts": [[2002, 1]]}}
    m = records.parse_messages(spark.createDataFrame([(json.dumps(msg),)], "value string")).first()
    assert (m["first_page"], m["last_page"], m["authors"], m["year"]) == ("1", "9", ["A, B"], 2002)
    sch = {"paperId": "p", "externalIds": {"DOI": "10.1/C", "PubMed": "7"}, "journal": {"name": "J"}, "references": [{"paperId": "q"}], "citations": [{"paperId": "z"}]}
    s = records.parse_scholar(spark.createDataFrame([(json.dumps(sch),)], "value string"))
    assert s.first()["venue"] == "J" and s.first()["pubmed_id"] == "7"
    assert sorted(tuple(x) for x in records.citation_edges(s, "s2_id", citers="citers").collect()) == [("p", "q"), ("z", "p")]


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></Abstract>'
        "<Journal><Title>J</Title><JournalIssue><Volume>3</Volume><PubDate><Year>2003</Year></PubDate></JournalIssue></Journal><Pagination><MedlinePgn>1-9</MedlinePgn></Pagination></Article>"
        '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"><PMID>8</PMID></CommentsCorrections></CommentsCorrectionsList></MedlineCitation>'
        '<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/Q</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>'
    )
    r = records.read_articles(spark, str(tmp_path / "a.xml")).first()
    assert r["abstract"] == "AIM: x\nEND: y" and r["doi"] == "10.1/q" and r["retracted"] and r["year"] == 2003 and r["last_page"] == "9"


def test_ids_and_categories(spark, tmp_path):
    for i, t in enumerate(("[1, 2]", '{"ids": [2, 3]}', '{"papers": [{"id": 4}]}')):
        (tmp_path / f"{i}.json").write_text(t)
    assert sorted(r[0] for r in records.read_ids(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "map.tsv").write_text("a\ttopic\n\nb\tbad\n")
    mapping = records.read_tag_categories(spark, str(tmp_path / "m"))
    with pytest.raises(Exception):
        mapping.collect()
    tags = spark.createDataFrame([(1, "a", None), (2, "a", None)], "paper_id long, tag string, category string")
    assert {r["category"] for r in records.apply_categories(tags, spark.createDataFrame([("a", "topic")], "tag string, category string")).collect()} == {"topic"}


def test_snapshot(spark, sf_dir, tmp_path):
    from graphlens.plans.views import Corpus

    c = Corpus(spark, sf_dir)
    v = c.table("embeddings").select((F.col("vec_id") + 1).alias("node_id"), F.col("embedding").alias("vec"))
    m = records.snapshot(c.papers, c.edges, v, str(tmp_path / "b"))
    assert m["nodes"] == c.nodeset.count() and 0 <= m["edges_percent"] <= 100
    assert records.subset_index(spark, str(tmp_path)).first()["bundle"] == "b"
    nodes = spark.read.parquet(str(tmp_path / "b" / "nodes")).orderBy("node_id").collect()
    assert [r["node_id"] for r in nodes] == list(range(len(nodes)))


@pytest.mark.parametrize("bad", ["", "drop table x", "select 1; select 2", "insert into x values (1)", "with a as (select 1) delete from a", "update x set y = 1", "select 'drop'", "pragma x", "-- only a comment"])
def test_guard_refuses(bad):
    with pytest.raises(sql_surface.NotReadOnly):
        sql_surface.check_select(bad)


def test_guard_allows_and_caps(spark):
    spark.range(20).createOrReplaceTempView("numbers")
    df, more = sql_surface.search(spark, "with a as (select id from numbers) select * from a order by id;", 5)
    assert more and df.count() == 5
    assert sql_surface.search(spark, "/* x */ select 1 as one")[1] is False
    assert "O''Brien" in sql_surface.guided_sql(title="O'Brien", year_from=2015, cited=5)
    with pytest.raises(ValueError):
        sql_surface.selector(seeds=True, year=2000)
    assert sql_surface.result_text(spark.range(2), "csv").splitlines() == ["id", "0", "1"]


def test_planner():
    mods = [planner.Module("c", ("b",), ("c",)), planner.Module("a", (), ("a",)), planner.Module("b", ("a",), ("b",))]
    assert planner.plan(mods) == ["a", "b", "c"]
    assert planner.run_lanes({"x": ((), lambda: 2), "y": (("x",), lambda v: v * 3)}) == {"x": 2, "y": 6}
    with pytest.raises(planner.CycleError):
        planner.order({"a": {"b"}, "b": {"a"}})
    r = planner.algorithms()
    with pytest.raises(ValueError):
        r.run("hdbscan", None, nonsense=1)


def test_late_edges_stream(spark, tmp_path):
    papers = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "id long, doi string, s2_id string, oa_id string")
    src = tmp_path / "in"
    src.mkdir()
    schema = "id long, citing_doi string, cited_doi string"
    run = lambda p: ingest.edges_in_batches(ingest.read_stream(spark, str(src), schema, 1), p, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    (src / "0.json").write_text('{"id":1,"citing_doi":"a","cited_doi":"b"}\n{"id":2,"citing_doi":"a","cited_doi":"c"}\n')
    run(papers)
    assert [tuple(r) for r in ingest.latest_version(spark, str(tmp_path / "state"), "edges", 0).collect()] == [(1, 2)]
    more = papers.unionAll(spark.createDataFrame([(3, "c", None, None)], papers.schema))
    (src / "1.json").write_text('{"id":5,"citing_doi":"b","cited_doi":"b"}\n')
    run(more)
    assert sorted(tuple(r) for r in ingest.latest_version(spark, str(tmp_path / "state"), "edges", 1).collect()) == [(1, 2), (1, 3)]
    assert ingest.latest_version(spark, str(tmp_path / "state"), "pending", 1).count() == 0


def test_event_windows_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    q = ingest.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["w"]["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()}
    want = {(r["w"]["start"], r["event_type"]): r["n"] for r in ingest.event_windows(batch).collect()}
    assert got == want


def test_dirty_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "id long, v string")
    assert sorted(r[0] for r in ingest.dirty(a, b, "id").collect()) == [2, 3]


def test_papers_stream_merges_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "doi string, s2_id string, oa_id string, title string, year int"
    run = lambda: ingest.papers_in_batches(ingest.read_stream(spark, str(src), schema, 1), ("title", "year"), str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    (src / "0.json").write_text('{"doi":"a","title":"A"}\n{"s2_id":"s","year":2001}\n{"doi":"z","title":"Z"}\n{"doi":"z","year":1999}\n')
    run()
    first = ingest.latest_version(spark, str(tmp_path / "state"), "papers", 0).where("tombstone = 0")
    assert sorted((r["doi"] or "", r["s2_id"] or "") for r in first.collect()) == [("", "s"), ("a", ""), ("z", "")]
    (src / "1.json").write_text('{"doi":"a","s2_id":"s","oa_id":"W"}\n')
    run()
    got = ingest.latest_version(spark, str(tmp_path / "state"), "papers", 1).where("tombstone = 0").collect()
    assert sorted((r["doi"], r["s2_id"], r["oa_id"], r["title"], r["year"]) for r in got) == [("a", "s", "W", "A", 2001), ("z", None, None, "Z", 1999)]
    assert ingest.latest_version(spark, str(tmp_path / "state"), "aliases", 1).count() == 3
