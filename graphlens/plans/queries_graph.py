"""Registered queries: graph, vectors, clustering, metrics, labels, late edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlens.operators import cluster, components, graph, labels, layout, metrics, vectors
from graphlens.plans.views import REACH, Corpus
from graphlens.registry import query


def _nodes(c: Corpus):
    """Embeddings as nodes ``(node_id, vec)``."""
    return c.table("embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _labels(c: Corpus):
    """Embedding labels as clusters."""
    return c.table("embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("cluster_id"))


def _side(c: Corpus, name: str):
    return c.clusters.select("node_id", F.col(name).alias("cluster_id"))


def _links(c: Corpus):
    """Citations between embedding nodes."""
    return c.edges.select((F.col("citing_id") - 1).alias("citing_id"), (F.col("cited_id") - 1).alias("cited_id"))


@query(
    "top_cited",
    """SELECT p.id, p.year, CAST(COUNT(*) AS BIGINT) AS cited_by FROM canon c JOIN papers p ON p.id = c.cited_id
       WHERE c.citing_id <> c.cited_id AND p.is_rejected = 0 AND p.is_stub = 0 AND p.tombstone = 0 AND p.title IS NOT NULL AND p.abstract IS NOT NULL
       GROUP BY p.id, p.year ORDER BY cited_by DESC, p.id ASC LIMIT 20""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return graph.top_cited(c.papers, c.edges, c.aliases)


@query("canonical_edges", "SELECT citing_id, cited_id FROM canon")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.canonical_edges(c.edges, c.aliases)


@query("edges_within_node_set", "SELECT e.citing_id, e.cited_id FROM edges e WHERE e.citing_id IN (SELECT id FROM nodeset) AND e.cited_id IN (SELECT id FROM nodeset)")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.within(c.edges, c.nodeset)


@query("in_degree", "SELECT cited_id AS id, CAST(COUNT(*) AS BIGINT) AS n FROM edges GROUP BY cited_id")
def _(spark, d):
    return Corpus(spark, d).edges.groupBy(F.col("cited_id").alias("id")).agg(F.count("*").alias("n"))


@query("imported_edges", "SELECT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b, ROW_NUMBER() OVER (PARTITION BY LEAST(l_partkey, l_suppkey), GREATEST(l_partkey, l_suppkey) ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_partkey < 500 AND l_suppkey < 500 AND l_partkey <> l_suppkey) t WHERE n = 1")
def _(spark, d):
    raw = Corpus(spark, d).lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return graph.import_edges(raw, 500)[0]


@query("pending_degree_histogram", "SELECT deg, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT cited_doi, CAST(COUNT(DISTINCT citing_doi) AS BIGINT) AS deg FROM pending WHERE cited_doi IS NOT NULL GROUP BY cited_doi) t GROUP BY deg")
def _(spark, d):
    return graph.pending_degree(Corpus(spark, d).pending)


@query(
    "ghosts_kept",
    """WITH s AS (SELECT citing_id AS g, cited_id AS p FROM edges UNION SELECT cited_id, citing_id FROM edges),
       t AS (SELECT g AS id, CAST(COUNT(DISTINCT p) AS BIGINT) AS degree FROM s WHERE p IN (SELECT id FROM nodeset) AND g NOT IN (SELECT id FROM nodeset) GROUP BY g)
       SELECT t.id, t.degree, CASE WHEN p.is_stub = 1 THEN 'pending' ELSE 'missing-data' END AS kind FROM t JOIN papers p ON p.id = t.id WHERE (p.is_stub = 1 AND t.degree >= 2) OR (p.is_stub = 0 AND t.degree >= 1)""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return graph.ghost_keep(c.edges, c.nodeset, c.papers)


_ENDS = """WITH h AS (SELECT DISTINCT k.id, p.id AS p FROM pending k JOIN papers p ON p.doi = k.citing_doi OR p.s2_id = k.citing_s2_id), a AS (SELECT id, MIN(p) AS p FROM h GROUP BY id HAVING COUNT(*) = 1),
       i AS (SELECT DISTINCT k.id, p.id AS p FROM pending k JOIN papers p ON p.doi = k.cited_doi OR p.s2_id = k.cited_s2_id OR p.oa_id = k.cited_oa_id), b AS (SELECT id, MIN(p) AS p FROM i GROUP BY id HAVING COUNT(*) = 1)"""


@query("promoted_edges", f"{_ENDS} SELECT DISTINCT a.p AS citing_id, b.p AS cited_id FROM a JOIN b ON a.id = b.id WHERE a.p <> b.p")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.promote(c.pending, c.papers)[0]


@query("still_pending", f"{_ENDS} SELECT k.id FROM pending k LEFT JOIN a ON a.id = k.id LEFT JOIN b ON b.id = k.id WHERE a.p IS NULL OR b.p IS NULL")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.promote(c.pending, c.papers)[1].select("id")


@query("backfilled_dois", "WITH k AS (SELECT s2_id, MIN(doi) AS doi FROM papers WHERE doi IS NOT NULL AND s2_id IS NOT NULL GROUP BY s2_id) SELECT p.id, COALESCE(p.citing_doi, a.doi) AS citing_doi, COALESCE(p.cited_doi, b.doi) AS cited_doi FROM pending p LEFT JOIN k a ON a.s2_id = p.citing_s2_id LEFT JOIN k b ON b.s2_id = p.cited_s2_id")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.backfill_dois(c.pending, c.papers).select("id", "citing_doi", "cited_doi")


_FLOW = "SELECT a.coarse AS src, b.coarse AS dst, CAST(COUNT(*) AS BIGINT) AS n FROM edges e JOIN clusters a ON a.node_id = e.citing_id JOIN clusters b ON b.node_id = e.cited_id WHERE a.coarse >= 0 AND b.coarse >= 0 GROUP BY a.coarse, b.coarse"


@query("cluster_flow", _FLOW)
def _(spark, d):
    c = Corpus(spark, d)
    return graph.cluster_flow(c.edges, _side(c, "coarse"))


@query("flow_degrees", f"WITH f AS ({_FLOW}) SELECT cluster_id, CAST(SUM(o) AS BIGINT) AS out_n, CAST(SUM(i) AS BIGINT) AS in_n, CAST(SUM(s) AS BIGINT) AS intra_n FROM (SELECT src AS cluster_id, CASE WHEN src <> dst THEN n ELSE 0 END AS o, 0 AS i, CASE WHEN src = dst THEN n ELSE 0 END AS s FROM f UNION ALL SELECT dst, 0, CASE WHEN src <> dst THEN n ELSE 0 END, 0 FROM f) t GROUP BY cluster_id")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.flow_degrees(graph.cluster_flow(c.edges, _side(c, "coarse")))


@query("bridge_clusters", "WITH n AS (SELECT fine, coarse, COUNT(*) AS n FROM clusters WHERE fine >= 0 GROUP BY fine, coarse) SELECT fine AS cluster_id, CAST(SUM(n) AS BIGINT) AS members, CAST(COUNT(*) AS BIGINT) AS span, ROUND(CAST(MAX(n) AS DOUBLE) / SUM(n), 9) AS dominant FROM n GROUP BY fine")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.bridges(_side(c, "fine"), _side(c, "coarse")).select("cluster_id", "members", "span", F.round("dominant", 9).alias("dominant"))


@query("bridge_pair_count", "SELECT CAST(COUNT(*) AS BIGINT) AS bridges FROM (SELECT fine FROM clusters WHERE fine >= 0 AND coarse >= 0 GROUP BY fine HAVING COUNT(DISTINCT coarse) >= 2) t")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.bridge_pair_count(_side(c, "fine"), _side(c, "coarse"))


@query(
    "gated_ladder",
    """WITH s AS (SELECT coarse AS cluster_id, CASE WHEN coarse % 2 = 0 THEN 4 ELSE 2 END AS score FROM clusters WHERE coarse >= 0 GROUP BY coarse),
       n AS (SELECT fine, coarse, COUNT(*) AS n FROM clusters WHERE fine >= 0 GROUP BY fine, coarse),
       r AS (SELECT n.*, COALESCE(s.score >= 3, FALSE) AS ok, ROW_NUMBER() OVER (PARTITION BY fine ORDER BY n.n DESC, coarse) AS k FROM n LEFT JOIN s ON s.cluster_id = n.coarse)
       SELECT fine AS cluster_id, COUNT(*) >= 2 AND CAST(MAX(n) AS DOUBLE) / SUM(n) < 0.8 AS is_bridge,
              CASE WHEN COUNT(*) >= 2 AND CAST(MAX(n) AS DOUBLE) / SUM(n) < 0.8 THEN BOOL_OR(ok) ELSE BOOL_OR(ok AND k = 1) END AS scoreable FROM r GROUP BY fine""",
)
def _(spark, d):
    c = Corpus(spark, d)
    scores = _side(c, "coarse").where("cluster_id >= 0").groupBy("cluster_id").agg(F.max(F.when(F.col("cluster_id") % 2 == 0, 4).otherwise(2)).alias("score"))
    return graph.gate(_side(c, "fine"), _side(c, "coarse"), scores)


@query("hop_distance", "WITH RECURSIVE s AS (SELECT citing_id AS a, cited_id AS b FROM edges UNION SELECT cited_id, citing_id FROM edges), w(node_id, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT s.b, w.hops + 1 FROM w JOIN s ON s.a = w.node_id WHERE w.hops < 3) SELECT node_id, MIN(hops) AS hops FROM w GROUP BY node_id")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.hops(c.edges, spark.range(1, 2).select(F.col("id").alias("node_id")), limit=3)


@query(
    "graph_neighbours",
    """WITH s AS (SELECT citing_id AS a, cited_id AS b FROM edges UNION SELECT cited_id, citing_id FROM edges), z AS (SELECT id AS node_id, id AS neighbour, 0 AS hops FROM nodeset),
       x AS (SELECT a AS node_id, b AS neighbour, 1 AS hops FROM s WHERE a IN (SELECT id FROM nodeset)), y1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY node_id ORDER BY neighbour) AS n FROM x),
       one AS (SELECT node_id, neighbour, hops FROM y1 WHERE n <= 8), t AS (SELECT DISTINCT o.node_id, s.b AS neighbour, 2 AS hops FROM one o JOIN s ON s.a = o.neighbour),
       u AS (SELECT t.* FROM t LEFT JOIN (SELECT * FROM z UNION ALL SELECT * FROM one) k ON k.node_id = t.node_id AND k.neighbour = t.neighbour WHERE k.node_id IS NULL),
       v AS (SELECT * FROM z UNION ALL SELECT * FROM one UNION ALL SELECT * FROM u)
       SELECT node_id, neighbour, hops FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node_id ORDER BY hops, neighbour) AS n FROM v) w WHERE n <= 8""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return graph.graph_neighbours(c.edges, c.nodeset.select(F.col("id").alias("node_id")), k=8, limit=2)


@query("citation_components", f"WITH RECURSIVE link AS (SELECT citing_id AS a, cited_id AS b FROM edges UNION SELECT cited_id, citing_id FROM edges), {REACH} SELECT node, component FROM reach")
def _(spark, d):
    return components.connected_components(Corpus(spark, d).edges, "citing_id", "cited_id")


@query(
    "diffusion_one_step",
    """WITH v AS (SELECT vec_id AS n, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS i FROM embeddings),
       s AS (SELECT citing_id - 1 AS a, cited_id - 1 AS b FROM edges UNION SELECT cited_id - 1, citing_id - 1 FROM edges),
       m AS (SELECT s.a AS n, v.i, AVG(CAST(v.x AS DOUBLE)) AS x FROM s JOIN v ON v.n = s.b GROUP BY s.a, v.i)
       SELECT v.n AS node_id, CAST(v.i AS INT) AS dim, ROUND(0.7 * CAST(v.x AS DOUBLE) + COALESCE(0.3 * m.x, 0), 6) AS x FROM v LEFT JOIN m ON m.n = v.n AND m.i = v.i""",
)
def _(spark, d):
    c = Corpus(spark, d)
    out = graph.diffuse(_nodes(c), _links(c), 0.3, 1)
    return out.select("node_id", F.posexplode("vec").alias("dim", "x")).select("node_id", "dim", F.round("x", 6).alias("x"))


_GHOSTS = "s AS (SELECT citing_id AS a, cited_id AS b FROM edges UNION SELECT cited_id, citing_id FROM edges), g AS (SELECT s.a AS id FROM s JOIN papers p ON p.id = s.a WHERE s.b IN (SELECT id FROM nodeset) AND s.a NOT IN (SELECT id FROM nodeset) GROUP BY s.a, p.is_stub HAVING (p.is_stub = 1 AND COUNT(*) >= 2) OR (p.is_stub = 0 AND COUNT(*) >= 1))"


@query("bridged_pairs", f"WITH {_GHOSTS}, arms AS (SELECT a AS g, b AS r FROM s WHERE a IN (SELECT id FROM g) AND b NOT IN (SELECT id FROM g)) SELECT x.r AS a, y.r AS b, CAST(COUNT(*) AS BIGINT) AS ghosts FROM arms x JOIN arms y ON x.g = y.g AND x.r < y.r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = x.r AND s.b = y.r) GROUP BY x.r, y.r")
def _(spark, d):
    c = Corpus(spark, d)
    ghosts = graph.ghost_keep(c.edges, c.nodeset, c.papers).select(F.col("id").alias("node_id"))
    return graph.bridged_pairs(c.edges, ghosts)


@query("dirichlet_energy", "WITH p AS (SELECT e.citing_id AS c, e.cited_id AS d, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x FROM edges e JOIN embeddings a ON a.vec_id = e.citing_id - 1 JOIN embeddings b ON b.vec_id = e.cited_id - 1) SELECT CAST(COUNT(*) AS BIGINT) AS edges, ROUND(SUM(x * x), 5) AS energy FROM p")
def _(spark, d):
    c = Corpus(spark, d)
    return graph.dirichlet(_links(c), _nodes(c)).select("edges", F.round("energy", 5).alias("energy"))


# vectors

_DIST = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("nearest_neighbours", f"SELECT node_id, neighbour, rank, ROUND(dist, 6) AS dist FROM (SELECT a.vec_id AS node_id, b.vec_id AS neighbour, {_DIST} AS dist, CAST(ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS INT) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) t WHERE rank <= 5")
def _(spark, d):
    return vectors.knn(_nodes(Corpus(spark, d)), 5).withColumn("dist", F.round("dist", 6))


@query("vector_distances", "SELECT a.vec_id, ROUND(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS euclid, ROUND(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    n = _nodes(Corpus(spark, d))
    j = n.join(n.select((F.col("node_id") - 1).alias("node_id"), F.col("vec").alias("other")), "node_id")
    return j.select(F.col("node_id").alias("vec_id"), F.round(vectors.euclid(F.col("vec"), F.col("other")), 6).alias("euclid"), F.round(vectors.cosine_distance(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query("closest_pairs", f"SELECT a, b FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY dist, a, b) AS n, COUNT(*) OVER () AS pairs FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) t) u WHERE n <= FLOOR(0.01 * pairs + 0.5)")
def _(spark, d):
    return vectors.closest_pairs(_nodes(Corpus(spark, d)), 0.01).select("a", "b")


@query("channel_variance", "SELECT CAST(i AS INT) AS dim, ROUND(VAR_POP(CAST(x AS DOUBLE)), 8) AS var FROM (SELECT UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS i FROM embeddings) t GROUP BY i")
def _(spark, d):
    return vectors.variance(_nodes(Corpus(spark, d))).select("dim", F.round("var", 8).alias("var"))


@query("cluster_centres", "WITH v AS (SELECT label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, AVG(CAST(x AS DOUBLE)) AS m, VAR_POP(CAST(x AS DOUBLE)) AS v, COUNT(*) AS n FROM v GROUP BY label, i) SELECT label AS cluster_id, CAST(MAX(n) AS BIGINT) AS count, ROUND(SQRT(SUM(v)), 6) AS spread, ROUND(SUM(m), 6) AS mass FROM m GROUP BY label")
def _(spark, d):
    c = Corpus(spark, d)
    return vectors.centroids(_nodes(c), _labels(c)).select("cluster_id", "count", F.round("spread", 6).alias("spread"), F.round(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x), 6).alias("mass"))


@query("principal_axes")
def _(spark, d):
    out, _ = vectors.pca(_nodes(Corpus(spark, d)), 3)
    return out.select("node_id", *(F.round(F.col("vec")[i], 4).alias(f"p{i}") for i in range(3)))


def _positions(c: Corpus):
    return _nodes(c).select("node_id", *(F.col("vec")[i].alias(n) for i, n in enumerate("xyz")))


@query("node_displacement")
def _(spark, d):
    p = _positions(Corpus(spark, d))
    moved = p.select("node_id", (F.col("y") * 2 + 1).alias("x"), (F.col("x") * -2).alias("y"), (F.col("z") * 2 + F.when(F.col("node_id") % 50 == 0, 1.0).otherwise(0.0)).alias("z"))
    return vectors.displacement(p, moved)[0].select("node_id", F.round("dist", 4).alias("dist"))


@query("blended_positions", "SELECT vec_id AS node_id, ROUND(0.75 * CAST(embedding[1] AS DOUBLE) + 0.25 * CAST(embedding[2] AS DOUBLE), 6) AS x FROM embeddings")
def _(spark, d):
    p = _positions(Corpus(spark, d))
    other = p.select("node_id", F.col("y").alias("x"), F.col("x").alias("y"), "z")
    return vectors.blend(p, other, 0.25).select("node_id", F.round("x", 6).alias("x"))


# clustering


def _component_sql(k: int, link: str) -> str:
    return f"""WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
        top AS (SELECT a, b FROM near WHERE rank <= {k}), link AS ({link}), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        root AS (SELECT a AS node_id, MIN(b) AS root FROM reach GROUP BY a) SELECT node_id, CAST(DENSE_RANK() OVER (ORDER BY root) - 1 AS INT) AS cluster_id FROM root"""


@query("mutual_neighbour_clusters", _component_sql(5, "SELECT x.a, x.b FROM top x JOIN top y ON y.a = x.b AND y.b = x.a"))
def _(spark, d):
    return cluster.mutual_knn(_nodes(Corpus(spark, d)), 5)


@query("neighbour_components", _component_sql(8, "SELECT a, b FROM top UNION SELECT b, a FROM top"))
def _(spark, d):
    return cluster.knn_components(_nodes(Corpus(spark, d)), 8)


@query("hdbscan_clusters")
def _(spark, d):
    return cluster.hdbscan(_nodes(Corpus(spark, d)), 5, 5)[0]


@query("force_layout")
def _(spark, d):
    c = Corpus(spark, d)
    e = _links(c).select(F.col("citing_id").alias("a"), F.col("cited_id").alias("b"))
    years = c.papers.select((F.col("id") - 1).alias("node_id"), ((F.col("year") - 1990) / 34).alias("t"))
    return layout.drawing(_nodes(c).select("node_id").join(years, "node_id"), e)


# metrics

_N = "WITH t AS (SELECT fine AS ca, coarse AS cb, COUNT(*) AS n FROM clusters GROUP BY fine, coarse), a AS (SELECT ca, SUM(n) AS n FROM t GROUP BY ca), b AS (SELECT cb, SUM(n) AS n FROM t GROUP BY cb), z AS (SELECT CAST(SUM(n) AS DOUBLE) AS n FROM t)"


@query("contingency", "SELECT fine AS ca, coarse AS cb, CAST(COUNT(*) AS BIGINT) AS n FROM clusters GROUP BY fine, coarse")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.contingency(_side(c, "fine"), _side(c, "coarse"))


@query("adjusted_rand", f"{_N}, s AS (SELECT (SELECT SUM(n * (n - 1)) / 2.0 FROM t) AS s, (SELECT SUM(n * (n - 1)) / 2.0 FROM a) AS p, (SELECT SUM(n * (n - 1)) / 2.0 FROM b) AS q, n * (n - 1) / 2 AS c FROM z) SELECT ROUND(CAST((s - p * q / c) / ((p + q) / 2 - p * q / c) AS DOUBLE), 9) AS ari FROM s")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.adjusted_rand(_side(c, "fine"), _side(c, "coarse")).select(F.round("ari", 9).alias("ari"))


@query("normalised_information", f"{_N}, m AS (SELECT SUM(t.n / z.n * LN(t.n * z.n / (a.n * b.n))) AS mi FROM t JOIN a ON a.ca = t.ca JOIN b ON b.cb = t.cb CROSS JOIN z), ha AS (SELECT -SUM(a.n / z.n * LN(a.n / z.n)) AS h FROM a CROSS JOIN z), hb AS (SELECT -SUM(b.n / z.n * LN(b.n / z.n)) AS h FROM b CROSS JOIN z) SELECT ROUND(2 * m.mi / (ha.h + hb.h), 9) AS nmi FROM m, ha, hb")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.normalised_mutual_information(_side(c, "fine"), _side(c, "coarse")).select(F.round("nmi", 9).alias("nmi"))


@query(
    "adjusted_information",
    f"""{_N}, m AS (SELECT SUM(t.n / z.n * LN(t.n * z.n / (a.n * b.n))) AS mi FROM t JOIN a ON a.ca = t.ca JOIN b ON b.cb = t.cb CROSS JOIN z), ha AS (SELECT -SUM(a.n / z.n * LN(a.n / z.n)) AS h FROM a CROSS JOIN z), hb AS (SELECT -SUM(b.n / z.n * LN(b.n / z.n)) AS h FROM b CROSS JOIN z),
        c AS (SELECT CAST(a.n AS BIGINT) AS a, CAST(b.n AS BIGINT) AS b, CAST(z.n AS BIGINT) AS n, UNNEST(RANGE(GREATEST(1, CAST(a.n + b.n - z.n AS BIGINT)), CAST(LEAST(a.n, b.n) AS BIGINT) + 1)) AS x FROM a CROSS JOIN b CROSS JOIN z),
        e AS (SELECT SUM(CAST(x AS DOUBLE) / n * LN(CAST(n AS DOUBLE) * x / (CAST(a AS DOUBLE) * b)) * EXP(LGAMMA(a + 1) + LGAMMA(b + 1) + LGAMMA(n - a + 1) + LGAMMA(n - b + 1) - LGAMMA(n + 1) - LGAMMA(x + 1) - LGAMMA(a - x + 1) - LGAMMA(b - x + 1) - LGAMMA(n - a - b + x + 1))) AS e FROM c)
        SELECT ROUND((m.mi - e.e) / (GREATEST(ha.h, hb.h) - e.e), 6) AS ami FROM m, e, ha, hb""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return spark.createDataFrame([(round(metrics.adjusted_mutual_information(_side(c, "fine"), _side(c, "coarse")), 6),)], "ami double")


_J = "WITH t AS (SELECT fine AS ca, coarse AS cb, COUNT(*) AS n FROM clusters WHERE fine >= 0 AND coarse >= 0 GROUP BY fine, coarse), a AS (SELECT fine AS ca, COUNT(*) AS n FROM clusters WHERE fine >= 0 GROUP BY fine), b AS (SELECT coarse AS cb, COUNT(*) AS n FROM clusters WHERE coarse >= 0 GROUP BY coarse), j AS (SELECT t.ca, t.cb, t.n, CAST(t.n AS DOUBLE) / (a.n + b.n - t.n) AS jaccard FROM t JOIN a ON a.ca = t.ca JOIN b ON b.cb = t.cb)"


@query("cluster_jaccard", f"{_J} SELECT ca, cb, CAST(n AS BIGINT) AS n, ROUND(jaccard, 9) AS jaccard FROM j")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.jaccard(_side(c, "fine"), _side(c, "coarse")).withColumn("jaccard", F.round("jaccard", 9))


@query("best_jaccard", f"{_J} SELECT ca, cb, ROUND(jaccard, 9) AS jaccard FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ca ORDER BY jaccard DESC, cb) AS k FROM j) t WHERE k = 1")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.best_jaccard(_side(c, "fine"), _side(c, "coarse")).withColumn("jaccard", F.round("jaccard", 9))


@query("matched_jaccard")
def _(spark, d):
    c = Corpus(spark, d)
    got = metrics.matched_jaccard(_side(c, "fine"), _side(c, "coarse"), 3)
    return spark.createDataFrame([(a, b, j) for a, (b, j) in got.items()], "ca int, cb int, jaccard double")


@query("node_retention", "WITH t AS (SELECT node_id, fine AS ca, coarse AS cb FROM clusters), s AS (SELECT ca, cb, COUNT(*) AS n FROM t GROUP BY ca, cb), z AS (SELECT ca, COUNT(*) AS n FROM t GROUP BY ca) SELECT t.node_id, ROUND(CASE WHEN t.ca < 0 OR t.cb < 0 THEN NULL WHEN z.n = 1 THEN 1.0 ELSE CAST(s.n - 1 AS DOUBLE) / (z.n - 1) END, 9) AS retention FROM t JOIN s ON s.ca = t.ca AND s.cb = t.cb JOIN z ON z.ca = t.ca")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.retention(_side(c, "fine"), _side(c, "coarse")).select("node_id", F.round("retention", 9).alias("retention"))


@query("partition_change", "WITH t AS (SELECT fine, coarse, COUNT(*) AS n FROM clusters WHERE fine >= 0 GROUP BY fine, coarse) SELECT fine AS cluster_id, CAST(SUM(n) AS BIGINT) AS size, CAST(MAX(CASE WHEN coarse >= 0 THEN n ELSE 0 END) AS BIGINT) AS retained, CAST(SUM(n) - MAX(CASE WHEN coarse >= 0 THEN n ELSE 0 END) AS BIGINT) AS lost FROM t GROUP BY fine")
def _(spark, d):
    c = Corpus(spark, d)
    return metrics.compare(_side(c, "fine"), _side(c, "coarse")).drop("biggest_share")


# labels

_TOK = "LIST_FILTER(STRING_SPLIT_REGEX(LOWER(text), '[^a-z0-9]+'), lambda x: LENGTH(x) >= 3 AND NOT LIST_CONTAINS([" + ", ".join(f"'{w}'" for w in labels.tokens.__globals__["STOPWORDS"]) + "], x))"


def _texts(c: Corpus):
    return c.documents.select(F.col("doc_id").alias("node_id"), (F.col("doc_id") % 12).cast("int").alias("cluster_id"), "text")


@query(
    "class_terms",
    f"""WITH d AS (SELECT CAST(doc_id % 12 AS INT) AS cluster_id, text FROM documents), k AS (SELECT cluster_id, UNNEST({_TOK}) AS term FROM d),
        tf AS (SELECT cluster_id, term, COUNT(*) AS tf FROM k GROUP BY cluster_id, term), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), z AS (SELECT cluster_id, SUM(tf) AS total FROM tf GROUP BY cluster_id),
        s AS (SELECT tf.cluster_id, tf.term, CAST(tf.tf AS BIGINT) AS tf, CAST(df.df AS BIGINT) AS df, tf.tf / z.total * LN(1 + 12 / (1 + df.df)) AS score FROM tf JOIN df ON df.term = tf.term JOIN z ON z.cluster_id = tf.cluster_id),
        r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY ROUND(score, 12) DESC, term) AS INT) AS rank FROM s) SELECT cluster_id, term, tf, df, ROUND(score, 9) AS score, rank FROM r WHERE rank <= 4""",
)
def _(spark, d):
    return labels.class_tfidf(_texts(Corpus(spark, d))).withColumn("score", F.round("score", 9))


@query("banded_terms")
def _(spark, d):
    return labels.banded_terms(_texts(Corpus(spark, d))).withColumn("score", F.round("score", 9))


@query("key_phrases")
def _(spark, d):
    return labels.key_phrases(_texts(Corpus(spark, d))).select("cluster_id", F.array_join("phrases", "; ").alias("phrases"))


@query(
    "representative_nodes",
    """WITH v AS (SELECT vec_id, label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, AVG(CAST(x AS DOUBLE)) AS m FROM v GROUP BY label, i),
       s AS (SELECT v.vec_id, v.label, SUM(v.x * m.m) / (SQRT(SUM(CAST(v.x AS DOUBLE) * v.x)) * SQRT(SUM(m.m * m.m))) AS cosine FROM v JOIN m ON m.label = v.label AND m.i = v.i GROUP BY v.vec_id, v.label)
       SELECT label AS cluster_id, vec_id AS node_id, ROUND(cosine, 6) AS cosine FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS k FROM s) t WHERE k = 1""",
)
def _(spark, d):
    c = Corpus(spark, d)
    return labels.representatives(_nodes(c), _labels(c)).withColumn("cosine", F.round("cosine", 6))


@query("year_ranges", "SELECT coarse AS cluster_id, CAST(MIN(y) AS INT) AS low, CAST(MAX(y) AS INT) AS high, CAST(LIST_SORT(LIST(y))[CAST(FLOOR(COUNT(*) / 2) AS INT) + 1] AS INT) AS median FROM (SELECT c.coarse, p.year AS y FROM clusters c JOIN papers p ON p.id = c.node_id + 1 WHERE c.coarse >= 0) t GROUP BY coarse")
def _(spark, d):
    c = Corpus(spark, d)
    years = _side(c, "coarse").join(c.papers.select((F.col("id") - 1).alias("node_id"), "year"), "node_id")
    return labels.year_ranges(years)


@query("event_day_windows", "SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS day, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    w = Corpus(spark, d).events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", "total")
