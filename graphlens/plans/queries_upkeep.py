"""Registered queries: upkeep of the corpus and drawing derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators import claims, graph, maintenance, match, resolve
from graphlens.plans.views import Corpus
from graphlens.registry import query
from graphlens.sources import records


@query("stub_flags", "SELECT id, CAST(title IS NULL AND abstract IS NULL AND year IS NULL AS INT) AS is_stub FROM papers")
def _(spark, d):
    return Corpus(spark, d).papers.select("id", maintenance.stub_flag().alias("is_stub"))


@query("backfilled_venues", "WITH f AS (SELECT paper_id, ARG_MIN(value, observed_at * 1000 + LENGTH(source)) AS v FROM observations WHERE field = 'venue' GROUP BY paper_id) SELECT p.id, COALESCE(p.venue, f.v) AS venue FROM papers p LEFT JOIN f ON f.paper_id = p.id")
def _(spark, d):
    c = Corpus(spark, d)
    return maintenance.backfill_columns(c.papers.select("id", "venue"), c.observations, ["venue"])


@query("conflict_observations", "SELECT id AS paper_id, title AS value, '_incumbent' AS source FROM papers WHERE id % 5 = 0 UNION ALL SELECT id, LOWER(title), 's2_live' FROM papers WHERE id % 5 = 0")
def _(spark, d):
    p = Corpus(spark, d).papers
    log = p.where("id % 5 = 0").select(F.col("id").alias("paper_id"), F.lit("title").alias("field"), F.col("title").alias("existing_value"), F.lower("title").alias("proposed_value"), F.lit("s2_live").alias("proposed_source"), F.lit(1).alias("discovered_at"))
    return maintenance.conflict_observations(p, log).select("paper_id", "value", "source")


@query(
    "merged_corpora",
    """WITH o AS (SELECT id, doi, CASE WHEN id % 2 = 0 THEN 'new venue' END AS venue, 1 AS is_seed, is_rejected FROM papers WHERE id % 4 = 0), m AS (SELECT * FROM papers WHERE id % 8 <> 4)
       SELECT m.id, m.doi, COALESCE(m.venue, o.venue) AS venue, GREATEST(m.is_seed, COALESCE(o.is_seed, 0)) AS is_seed FROM m LEFT JOIN o ON o.doi = m.doi
       UNION ALL SELECT (SELECT MAX(id) FROM m) + o.id, o.doi, o.venue, o.is_seed FROM o LEFT JOIN m ON m.doi = o.doi WHERE m.id IS NULL""",
)
def _(spark, d):
    p = Corpus(spark, d).papers
    none = F.lit(None).cast("string")
    other = p.where("id % 4 = 0").select("id", "doi", none.alias("s2_id"), none.alias("oa_id"), F.when(F.col("id") % 2 == 0, "new venue").alias("venue"), F.lit(1).alias("is_seed"), "is_rejected")
    mine = p.where("id % 8 <> 4").select("id", "doi", none.alias("s2_id"), none.alias("oa_id"), "venue", "is_seed", "is_rejected")
    return maintenance.merge_corpora(mine, other, ["venue"]).select("id", "doi", "venue", "is_seed")


@query("marked_seeds", "SELECT id, CAST(CASE WHEN is_seed = 1 OR (doi IS NOT NULL AND id % 10 = 3) OR id IN (SELECT paper_id FROM observations WHERE starts_with(source, 'import_')) THEN 1 ELSE 0 END AS INT) AS is_seed FROM papers")
def _(spark, d):
    c = Corpus(spark, d)
    none = F.lit(None).cast("string")
    seeds = c.papers.where("id % 10 = 3").select(F.col("id").alias("idx"), "doi", none.alias("s2_id"), none.alias("oa_id"))
    return maintenance.mark_seeds(c.papers, seeds, c.observations, "import_").select("id", "is_seed")


@query("swept_retractions", "SELECT id, CASE WHEN id % 3 = 0 THEN 'retracted' WHEN editorial_status IN ('retracted', 'withdrawn') THEN editorial_status ELSE 'concern' END AS editorial_status FROM papers WHERE doi IS NOT NULL AND id % 2 = 0")
def _(spark, d):
    p = Corpus(spark, d).papers
    notices = p.where("doi is not null and id % 2 = 0").select(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.when(F.col("id") % 3 == 0, "Retraction of").otherwise("Expression of Concern").alias("notice"))
    return maintenance.sweep_retractions(p, notices)


@query("bulk_filled", "WITH b AS (SELECT CONCAT('s', CAST(p_partkey AS VARCHAR(20))) AS s2_id, MIN(p_name) AS venue FROM part GROUP BY 1) SELECT p.id, COALESCE(p.venue, b.venue) AS venue FROM papers p LEFT JOIN b ON b.s2_id = p.s2_id")
def _(spark, d):
    c = Corpus(spark, d)
    bulk = c.part.select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("s2_id"), F.col("p_name").alias("venue"))
    return maintenance.bulk_fill(c.papers, bulk, "s2_id", ["venue"]).select("id", "venue")


@query("corpus_map_join", "SELECT p.id AS paper_id, c.c_acctbal AS value FROM customer c JOIN papers p ON p.s2_id = CONCAT('s', CAST(c.c_custkey AS VARCHAR(20)))")
def _(spark, d):
    c = Corpus(spark, d)
    rows = c.customer.select(F.col("c_custkey").alias("corpusid"), F.col("c_acctbal").alias("value"))
    ids = c.customer.select(F.col("c_custkey").alias("corpusid"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("s2_id"))
    return maintenance.map_join(rows, ids, c.papers)


@query(
    "ghost_stubs",
    """WITH a AS (SELECT k.id, MIN(p.id) AS p FROM pending k JOIN papers p ON p.doi = k.citing_doi OR p.s2_id = k.citing_s2_id GROUP BY k.id), b AS (SELECT k.id, MIN(p.id) AS p FROM pending k JOIN papers p ON p.doi = k.cited_doi OR p.s2_id = k.cited_s2_id GROUP BY k.id),
       j AS (SELECT k.*, a.p AS pa, b.p AS pb FROM pending k LEFT JOIN a ON a.id = k.id LEFT JOIN b ON b.id = k.id),
       g AS (SELECT pa AS p, cited_doi AS doi, cited_s2_id AS s2 FROM j WHERE pa IS NOT NULL AND pb IS NULL UNION ALL SELECT pb, citing_doi, citing_s2_id FROM j WHERE pb IS NOT NULL AND pa IS NULL)
       SELECT COALESCE(doi, s2) AS ghost, CAST(COUNT(DISTINCT p) AS BIGINT) AS degree FROM g GROUP BY COALESCE(doi, s2) HAVING COUNT(DISTINCT p) >= 2""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return maintenance.ghost_stubs(c.pending, c.papers).select("ghost", "degree")


@query("duplicate_records", "SELECT a.id AS a, b.id AS b, COALESCE(a.doi, b.doi) AS doi, COALESCE(a.s2_id, b.s2_id) AS s2_id, COALESCE(a.oa_id, b.oa_id) AS oa_id FROM papers a JOIN papers b ON a.title = b.title AND a.id < b.id AND a.year = b.year WHERE a.tombstone = 0 AND b.tombstone = 0 AND ((a.doi IS NULL) <> (b.doi IS NULL) OR (a.s2_id IS NULL) <> (b.s2_id IS NULL) OR (a.oa_id IS NULL) <> (b.oa_id IS NULL))")
def _(spark, d):
    p = Corpus(spark, d).papers
    return maintenance.duplicate_records(p, match.title_year_pairs(p))


@query("bib_id_cascade", "WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('10.1/', CAST(o_custkey AS VARCHAR)) END AS doi, CAST(o_custkey + 7000 AS VARCHAR) AS pm FROM orders) SELECT DISTINCT e.key, COALESCE(a.id, b.id) AS id FROM e LEFT JOIN papers a ON a.doi = e.doi LEFT JOIN papers b ON b.pubmed_id = e.pm WHERE COALESCE(a.id, b.id) IS NOT NULL")
def _(spark, d):
    c = Corpus(spark, d)
    s = lambda x: F.col(x).cast("string")
    entries = c.orders.select(s("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1/"), s("o_custkey"))).alias("doi"), (F.col("o_custkey") + 7000).cast("string").alias("pubmed_id"), F.lit("arxiv").alias("scheme"), F.lit("none").alias("value"))
    ids = c.papers.limit(0).select(F.col("id").alias("paper_id"), F.lit("x").alias("scheme"), F.lit("x").alias("value"))
    return maintenance.bib_ids(entries, c.papers.withColumn("citekey", F.lit(None).cast("string")), ids)


@query("attempt_mask", "SELECT paper_id, CAST(BIT_OR(CASE WHEN service = 'oa' AND status = 'succeeded' THEN 1 WHEN service = 'ncbi' AND status = 'failed' THEN 2 ELSE 0 END) AS INT) AS mask FROM attempts GROUP BY paper_id")
def _(spark, d):
    return maintenance.attempt_mask(Corpus(spark, d).attempts, {("oa", "succeeded"): 0, ("ncbi", "failed"): 1})


@query("scored_members", "SELECT node_id FROM clusters WHERE coarse IN (0, 2)")
def _(spark, d):
    c = Corpus(spark, d)
    labels = c.clusters.select("node_id", F.col("coarse").alias("cluster_id"))
    scores = labels.select("cluster_id").distinct().where("cluster_id >= 0").withColumn("score", F.when(F.col("cluster_id") % 2 == 0, 4.0).otherwise(1.0))
    return maintenance.scored_members(labels, scores, 3).select("node_id")


@query("visible_edges", "SELECT citing_id, cited_id FROM edges WHERE citing_id % 40 <> 0 AND cited_id % 40 <> 0")
def _(spark, d):
    e = Corpus(spark, d).edges
    ghosts = e.select(F.col("citing_id").alias("id")).union(e.select("cited_id")).where("id % 40 = 0").distinct()
    return maintenance.visible_edges(e, ghosts)


@query("node_classes", "SELECT node_id, CASE WHEN fine < 0 THEN 'noise' ELSE CONCAT('c', CAST(fine AS VARCHAR)) END AS class FROM clusters")
def _(spark, d):
    return maintenance.node_class("cluster", Corpus(spark, d).clusters.select("node_id", F.col("fine").alias("cluster_id")))


@query("rank_correlation", "WITH t AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, CAST(FLOOR(o_totalprice / 1000) AS DOUBLE) AS b FROM orders), r AS (SELECT RANK() OVER (ORDER BY a) + (COUNT(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, RANK() OVER (ORDER BY b) + (COUNT(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM t) SELECT ROUND(CORR(x, y), 9) AS rho FROM r")
def _(spark, d):
    t = Corpus(spark, d).orders.select(F.col("o_custkey").alias("a"), F.floor(F.col("o_totalprice") / 1000).alias("b"))
    return maintenance.spearman(t, "a", "b").select(F.round("rho", 9).alias("rho"))


@query("co_cluster_rate", "SELECT CAST(COUNT(*) AS BIGINT) AS pairs, CAST(SUM(CASE WHEN a.coarse = b.coarse THEN 1 ELSE 0 END) AS BIGINT) AS together FROM edges e JOIN clusters a ON a.node_id = e.citing_id JOIN clusters b ON b.node_id = e.cited_id WHERE a.coarse >= 0 AND b.coarse >= 0")
def _(spark, d):
    c = Corpus(spark, d)
    return maintenance.co_cluster_rate(c.edges.select(F.col("citing_id").alias("a"), F.col("cited_id").alias("b")), c.clusters.select("node_id", F.col("coarse").alias("cluster_id")))


@query("rewired_pairs")
def _(spark, d):
    return maintenance.rewired(Corpus(spark, d).edges.select(F.col("citing_id").alias("a"), F.col("cited_id").alias("b")))


@query("settled_by_id", "SELECT p.id AS paper_id, CASE WHEN p.doi IS NOT NULL THEN 'succeeded' ELSE 'failed' END AS status, p.doi FROM papers p WHERE p.s2_id IS NOT NULL AND p.id % 2 = 0")
def _(spark, d):
    p = Corpus(spark, d).papers
    return maintenance.settle_ids(p.where("s2_id is not null and id % 2 = 0").select(F.col("id").alias("paper_id"), "s2_id"), p.where("s2_id is not null").select("s2_id", "doi"), "s2_id", True)


@query("settled_fields", "SELECT p.id AS paper_id, 'venue' AS field, CASE WHEN q.venue IS NOT NULL THEN 'succeeded' ELSE 'failed' END AS status FROM papers p LEFT JOIN papers q ON q.oa_id = p.oa_id AND q.id % 3 <> 0 WHERE p.oa_id IS NOT NULL")
def _(spark, d):
    p = Corpus(spark, d).papers.where("oa_id is not null")
    items = p.select(F.col("id").alias("paper_id"), F.lit("venue").alias("field"), F.lower("oa_id").alias("oa_id"))
    return records.settle(items, p.where("id % 3 <> 0").select("oa_id", "venue"), "oa_id")


@query("union_of_edges", "SELECT citing_id, cited_id, CASE WHEN citing_id % 2 = 0 THEN 'oa' ELSE 's2' END AS provenance FROM edges WHERE citing_id % 2 = 0 OR cited_id % 3 = 0")
def _(spark, d):
    e = Corpus(spark, d).edges
    return graph.union_edges([e.where("citing_id % 2 = 0").withColumn("provenance", F.lit("oa")), e.where("cited_id % 3 = 0").withColumn("provenance", F.lit("s2"))])


@query("identifier_tails", "SELECT id, REGEXP_EXTRACT(CONCAT('https://x.org/', LOWER(oa_id)), '([A-Za-z0-9]+)/?$', 1) AS tail, UPPER(REGEXP_EXTRACT(CONCAT('https://x.org/', LOWER(oa_id)), '([A-Za-z0-9]+)/?$', 1)) AS work FROM papers WHERE oa_id IS NOT NULL")
def _(spark, d):
    url = F.concat(F.lit("https://x.org/"), F.lower("oa_id"))
    return Corpus(spark, d).papers.where("oa_id is not null").select("id", X.id_tail(url).alias("tail"), X.work_id(url).alias("work"))


@query("export_types", "SELECT id, CASE pub_type WHEN 'article' THEN 'article' WHEN 'book-chapter' THEN 'incollection' ELSE 'misc' END AS bib, CASE pub_type WHEN 'article' THEN 'JOUR' WHEN 'book-chapter' THEN 'CHAP' ELSE 'GEN' END AS ris FROM papers")
def _(spark, d):
    t = F.col("pub_type")
    return Corpus(spark, d).papers.select("id", X.map_type(t, X.BIB_TYPES, "misc").alias("bib"), X.map_type(t, X.RIS_TYPES, "GEN").alias("ris"))


@query("dates_split", "SELECT o_orderkey, CAST(REGEXP_EXTRACT(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\\b(\\d{4})\\b', 1) AS INT) AS year, SUBSTR(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 6, 2) AS month FROM orders")
def _(spark, d):
    day = F.col("o_orderdate").cast("date").cast("string")
    return Corpus(spark, d).orders.select("o_orderkey", X.year_of(day).alias("year"), X.month_of(day).alias("month"))


@query("conflict_log", "SELECT id AS paper_id, title AS existing_value, LOWER(SUBSTR(title, 1, 20)) AS proposed_value, 's2_live' AS proposed_source FROM papers WHERE id % 4 = 0 AND LOWER(title) <> LOWER(SUBSTR(title, 1, 20))")
def _(spark, d):
    p = Corpus(spark, d).papers.where("id % 4 = 0")
    row = lambda v, s: p.select(F.col("id").alias("paper_id"), F.lit("title").alias("field"), v.alias("value"), F.lit(s).alias("source"), F.lit(None).cast("string").alias("pub_type_hint"), F.lit(1).alias("observed_at"))
    o = row(F.col("title"), "s2_hop").unionAll(row(F.lower(F.substring("title", 1, 20)), "s2_live"))
    return resolve.conflict_log(resolve.resolve_fields(o), o, "2024-01-01 00:00:00").select("paper_id", "existing_value", "proposed_value", "proposed_source")


_ENDS = """WITH h AS (SELECT DISTINCT k.id, p.id AS p FROM pending k JOIN papers p ON p.doi = k.citing_doi OR p.s2_id = k.citing_s2_id), a AS (SELECT id, MIN(p) AS p FROM h GROUP BY id HAVING COUNT(*) = 1),
       i AS (SELECT DISTINCT k.id, p.id AS p FROM pending k JOIN papers p ON p.doi = k.cited_doi OR p.s2_id = k.cited_s2_id OR p.oa_id = k.cited_oa_id), b AS (SELECT id, MIN(p) AS p FROM i GROUP BY id HAVING COUNT(*) = 1)"""


@query("ingested_edges_left", f"{_ENDS} SELECT k.id FROM pending k LEFT JOIN a ON a.id = k.id LEFT JOIN b ON b.id = k.id WHERE a.p IS NULL OR b.p IS NULL OR a.p = b.p")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.ingest_edges(c.pending, c.papers)[1].select("id")


@query("marked_attempts", "SELECT status, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT status FROM attempts UNION ALL SELECT 'claimed' FROM (SELECT DISTINCT paper_id, service, field FROM attempts WHERE paper_id < 10) k) t GROUP BY status")
def _(spark, d):
    a = Corpus(spark, d).attempts
    return claims.mark(a, a.where("paper_id < 10"), "claimed", "2024-02-01 00:00:00").groupBy("status").agg(F.count("*").alias("n"))


@query("gradient_colours", "SELECT id, CAST(ROUND(255 * (year - 1990) / 40.0) AS INT) AS r, CAST(255 - ROUND(255 * (year - 1990) / 40.0) AS INT) AS b FROM papers WHERE (year - 1990) % 8 = 0")
def _(spark, d):
    p = Corpus(spark, d).papers.where("(year - 1990) % 8 = 0")
    g = X.gradient((F.col("year") - 1990) / 40.0, [(0, 0, 255), (255, 0, 0)])
    return p.select("id", g["r"].alias("r"), g["b"].alias("b"))
