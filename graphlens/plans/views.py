"""Derived bibliographic views over the generated tables, in SQL that both engines run.

The generated tables hold no papers or citations; these views give the engine a
deterministic citation corpus: documents become papers, consecutive order lines
become citations, events become enrichment attempts, embeddings become nodes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()

#: In order: a view may use those before it.
VIEWS = {
    "papers": """
      SELECT CAST(d.doc_id + 1 AS BIGINT) AS id, SPLIT_PART(d.text, CHR(10), 1) AS title,
             CASE WHEN d.n_chars >= 200 THEN d.text END AS abstract,
             CAST(1990 + d.doc_id % 35 AS INT) AS year,
             CASE WHEN d.doc_id % 5 <> 0 THEN CONCAT('10.1/', CAST(d.doc_id AS VARCHAR(20))) END AS doi,
             CASE WHEN d.doc_id % 3 <> 0 THEN CONCAT('s', CAST(d.doc_id AS VARCHAR(20))) END AS s2_id,
             CASE WHEN d.doc_id % 7 <> 0 THEN CONCAT('W', CAST(d.doc_id AS VARCHAR(20))) END AS oa_id,
             CASE WHEN d.doc_id % 4 = 1 THEN CAST(d.doc_id + 7000 AS VARCHAR(20)) END AS pubmed_id,
             CASE WHEN d.doc_id % 6 <> 2 THEN d.source END AS venue,
             CASE WHEN d.doc_id % 4 = 0 THEN 'article' WHEN d.doc_id % 4 = 1 THEN 'book-chapter' WHEN d.doc_id % 4 = 2 THEN 'preprint' END AS pub_type,
             CASE WHEN d.doc_id % 9 <> 0 THEN CONCAT('Smith, John ', d.lang) END AS authors,
             CASE WHEN d.doc_id % 50 = 7 THEN 'retracted' WHEN d.doc_id % 50 = 8 THEN 'withdrawn' WHEN d.doc_id % 50 = 9 THEN 'corrected' END AS editorial_status,
             CAST(COALESCE(l.quality, 0) AS INT) AS is_seed,
             CAST(CASE WHEN d.doc_id % 11 = 0 THEN 1 ELSE 0 END AS INT) AS is_stub,
             CAST(COALESCE(l.toxic, 0) AS INT) AS is_rejected,
             CAST(CASE WHEN d.doc_id % 13 = 0 THEN 1 ELSE 0 END AS INT) AS tombstone,
             CAST(d.doc_id % 6 AS INT) AS discovery_count, d.lang AS lang, d.source AS source
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "edges": """
      SELECT DISTINCT CAST(a.l_partkey + 1 AS BIGINT) AS citing_id, CAST(b.l_partkey + 1 AS BIGINT) AS cited_id
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
      WHERE a.l_partkey <> b.l_partkey""",
    "aliases": """
      SELECT id AS loser_id, id - 1 AS winner_id FROM papers WHERE tombstone = 1 AND id > 1""",
    "alias_chains": """
      SELECT CAST(s_suppkey + 2 AS BIGINT) AS loser_id, CAST(s_suppkey + 1 AS BIGINT) AS winner_id FROM supplier WHERE s_suppkey % 4 <> 3""",
    "canon": """
      SELECT DISTINCT COALESCE(x.winner_id, e.citing_id) AS citing_id, COALESCE(y.winner_id, e.cited_id) AS cited_id
      FROM edges e LEFT JOIN aliases x ON x.loser_id = e.citing_id LEFT JOIN aliases y ON y.loser_id = e.cited_id""",
    "nodeset": """
      SELECT id, title, abstract, year, doi, s2_id, oa_id, venue, is_seed FROM papers
      WHERE is_rejected = 0 AND is_stub = 0 AND tombstone = 0 AND title IS NOT NULL AND abstract IS NOT NULL""",
    "pending": """
      SELECT citing_id * 1000000000 + cited_id AS id,
             CASE WHEN citing_id % 3 <> 0 THEN CONCAT('10.1/', CAST(citing_id - 1 AS VARCHAR(20))) END AS citing_doi,
             CONCAT('s', CAST(citing_id - 1 AS VARCHAR(20))) AS citing_s2_id,
             CASE WHEN cited_id % 2 = 0 THEN CONCAT('10.1/', CAST(cited_id - 1 AS VARCHAR(20))) END AS cited_doi,
             CONCAT('s', CAST(cited_id - 1 AS VARCHAR(20))) AS cited_s2_id,
             CASE WHEN cited_id % 5 = 0 THEN CONCAT('W', CAST(cited_id - 1 AS VARCHAR(20))) END AS cited_oa_id
      FROM edges WHERE citing_id % 4 = 1""",
    "observations": """
      SELECT id AS paper_id, 'title' AS field, title AS value, 'openalex' AS source, 'article' AS pub_type_hint, CAST(1 AS INT) AS observed_at FROM papers WHERE id % 2 = 0
      UNION ALL SELECT id, 'title', CASE WHEN id % 6 = 0 THEN LOWER(title) ELSE title END, 's2_live', pub_type, 2 FROM papers WHERE id % 3 = 0
      UNION ALL SELECT id, 'title', CASE WHEN id % 10 = 0 THEN CONCAT(title, ' II') ELSE title END, 'crossref', pub_type, 3 FROM papers WHERE id % 5 = 0
      UNION ALL SELECT id, 'year', CAST(year AS VARCHAR(10)), 'oa_stub', pub_type, 1 FROM papers
      UNION ALL SELECT id, 'year', CAST(year + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR(10)), 's2_hop', pub_type, 2 FROM papers WHERE id % 2 = 0
      UNION ALL SELECT id, 'year', CAST(year + CASE WHEN id % 8 = 0 THEN 2 ELSE 0 END AS VARCHAR(10)), 'ncbi', pub_type, 3 FROM papers WHERE id % 4 = 0
      UNION ALL SELECT id, 'editorial_status', CASE WHEN id % 10 = 0 THEN 'Retracted article' WHEN id % 10 = 5 THEN 'has a Correction' ELSE 'Expression of Concern' END, 'crossref', pub_type, 1 FROM papers WHERE id % 5 = 0
      UNION ALL SELECT id, 'editorial_status', 'withdrawn', 'ncbi', pub_type, 2 FROM papers WHERE id % 15 = 0
      UNION ALL SELECT id, 'venue', CONCAT('  ', COALESCE(venue, 'none')), 'import_ris', pub_type, 1 FROM papers WHERE id % 7 = 0
      UNION ALL SELECT id, 'venue', UPPER(COALESCE(venue, 'none')), 's2_live', pub_type, 2 FROM papers WHERE id % 14 = 0""",
    "attempts": """
      SELECT CAST(user_id + 1 AS BIGINT) AS paper_id,
             CASE WHEN event_id % 4 = 0 THEN 'oa' WHEN event_id % 4 = 1 THEN 's2_live' WHEN event_id % 4 = 2 THEN 'ncbi' ELSE 'crossref' END AS service,
             CASE WHEN event_id % 3 = 0 THEN 'abstract' WHEN event_id % 3 = 1 THEN 'year' ELSE '_all' END AS field,
             CASE WHEN event_id % 5 < 2 THEN 'succeeded' WHEN event_id % 5 < 4 THEN 'failed' ELSE 'claimed' END AS status,
             ts AS claimed_at, event_id AS attempt_id
      FROM events""",
    "counts": """
      SELECT CAST(p_partkey + 1 AS BIGINT) AS paper_id, CASE WHEN p_size % 3 = 0 THEN 'oa' WHEN p_size % 3 = 1 THEN 's2' ELSE 'crossref' END AS source,
             CASE WHEN p_size % 4 <> 0 THEN CAST(p_size * 3 AS BIGINT) END AS cit_count, CAST(p_size AS BIGINT) AS ref_count FROM part""",
    "tags": """
      SELECT CAST(o_custkey + 1 AS BIGINT) AS paper_id, LOWER(o_orderpriority) AS tag, CASE WHEN o_orderstatus = 'F' THEN 'topic' WHEN o_orderstatus = 'O' THEN 'species' END AS category, o_orderkey AS added FROM orders""",
    "records": """
      SELECT CAST(o_orderkey AS BIGINT) AS idx, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('10.1/', CAST(o_custkey AS VARCHAR(20))) END AS doi,
             CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('s', CAST(o_custkey + o_orderkey % 2 AS VARCHAR(20))) END AS s2_id,
             CASE WHEN o_orderkey % 5 < 2 THEN CONCAT('W', CAST(o_custkey AS VARCHAR(20))) END AS oa_id FROM orders""",
    "clusters": """
      SELECT CAST(doc_id AS BIGINT) AS node_id, CAST(CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id % 12 END AS INT) AS fine,
             CAST(CASE WHEN doc_id % 19 = 0 THEN -1 WHEN doc_id % 5 = 0 THEN (doc_id % 12 + 1) % 4 ELSE doc_id % 4 END AS INT) AS coarse FROM documents""",
}

#: Smallest node reachable from every node of the undirected ``link(a, b)``; labels go down by keyed recursion.
REACH = """reach(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM link UNION
       (SELECT l.b AS node, MIN(u.component) AS component FROM reach u JOIN link l ON l.a = u.node JOIN recurring.reach r ON r.node = l.b WHERE u.component < r.component GROUP BY l.b))"""


def with_views(sql: str) -> str:
    """``sql`` with the views it names, and those they name, before it."""
    need, text = [], sql
    for name in reversed(VIEWS):
        if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text, re.I):
            need.append(name)
            text += VIEWS[name]
    if not need:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in reversed(need))
    more = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if more:
        return f"WITH {more[1] or ''}{ctes}, {sql[more.end():]}"
    return f"WITH {ctes} {sql}"


class Corpus:
    """Tables and derived views of one input folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """One generated table."""
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A statement over the tables and views."""
        text = with_views(text)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
