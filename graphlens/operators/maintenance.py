"""Upkeep of the corpus: backfills, corpus merges, seeds, retractions, bulk fills, stub ghosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import text as X
from graphlens.operators.match import KEYS, multi_key_match, priority_match


def stub_flag() -> Column:
    """1 where a record brings neither title, abstract nor year."""
    return (F.col("title").isNull() & F.col("abstract").isNull() & F.col("year").isNull()).cast("int")


def status_stamp(before: DataFrame, after: DataFrame, now: str) -> DataFrame:
    """``(id, editorial_status, editorial_status_at)``: stamped when a status appears or changes, else kept."""
    b = before.select("id", F.col("editorial_status").alias("__s"), F.col("editorial_status_at").alias("__at"))
    changed = F.col("editorial_status").isNotNull() & ~F.col("editorial_status").eqNullSafe(F.col("__s"))
    return after.select("id", "editorial_status").join(b, "id", "left").select("id", "editorial_status", F.when(changed, F.to_timestamp(F.lit(now))).otherwise(F.col("__at")).alias("editorial_status_at"))


def backfill_columns(papers: DataFrame, observations: DataFrame, columns: list[str]) -> DataFrame:
    """Null columns filled from the first observation of the field, in order of time and source."""
    first = observations.where(F.col("field").isin(*columns) & F.col("value").isNotNull()).groupBy("paper_id").pivot("field", columns)
    first = first.agg(F.min(F.struct("observed_at", "source", "value"))["value"].alias("v"))
    first = first.select(F.col("paper_id").alias("id"), *(F.col(c).alias(f"__{c}") for c in columns))
    types = dict(papers.dtypes)
    out = papers.join(first, "id", "left")
    return out.select(*(F.coalesce(c, F.col(f"__{c}").cast(types[c])).alias(c) if c in columns else F.col(c) for c in papers.columns))


def conflict_observations(papers: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Observations rebuilt from a conflict log: the incumbent of unknown source, and every proposed value.

    Identifier fields are left out; conflicts are ``(paper_id, field,
    existing_value, proposed_value, proposed_source, discovered_at)``.
    """
    c = conflicts.where(~F.col("field").isin(*KEYS)).join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    w = Window.partitionBy("paper_id", "field").orderBy("discovered_at", "proposed_source")
    first = c.withColumn("n", F.row_number().over(w)).where("n = 1 and existing_value is not null")
    old = first.select("paper_id", "field", F.col("existing_value").alias("value"), F.lit("_incumbent").alias("source"), F.lit(None).cast("string").alias("pub_type_hint"), F.lit(0).alias("observed_at"))
    new = c.where("proposed_value is not null").select("paper_id", "field", F.col("proposed_value").alias("value"), F.col("proposed_source").alias("source"), F.lit(None).cast("string").alias("pub_type_hint"), F.lit(1).alias("observed_at"))
    return old.unionAll(new).dropDuplicates(["paper_id", "field", "source"])


def merge_corpora(mine: DataFrame, other: DataFrame, fields: list[str]) -> DataFrame:
    """``mine`` with another corpus' papers: matched ones fill nulls and OR the flags, the rest get new ids."""
    cols = [*KEYS, *fields]
    hit = priority_match(other.withColumnRenamed("id", "idx"), mine).select(F.col("probe").alias("__o"), "paper")
    o = other.join(hit, other["id"] == hit["__o"], "left")
    w = Window.partitionBy("paper").orderBy("id")
    best = o.where("paper is not null").groupBy("paper").agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct("id", F.col(c).alias("v"))))["v"].alias(f"__{c}") for c in cols), F.max("is_seed").alias("__seed"), F.max("is_rejected").alias("__rej"))
    filled = mine.join(best, mine["id"] == best["paper"], "left")
    filled = filled.select("id", *(F.coalesce(c, f"__{c}").alias(c) for c in cols), F.greatest("is_seed", "__seed").alias("is_seed"), F.greatest("is_rejected", "__rej").alias("is_rejected"))
    top = mine.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = o.where("paper is null").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("id")).alias("id"), *cols, "is_seed", "is_rejected")  # top is one row
    return filled.unionByName(new)


def mark_seeds(papers: DataFrame, seeds: DataFrame, sources: DataFrame, prefix: str) -> DataFrame:
    """``papers`` with seeds set for those matched by identifier or observed by a source with ``prefix``."""
    ids = multi_key_match(seeds, papers).select(F.col("paper").alias("id"))
    ids = ids.union(sources.where(F.col("source").startswith(prefix)).select(F.col("paper_id").alias("id"))).distinct().withColumn("__seed", F.lit(1))
    return papers.join(ids, "id", "left").withColumn("is_seed", F.greatest("is_seed", F.coalesce("__seed", F.lit(0)))).select(papers.columns)


def sweep_retractions(papers: DataFrame, notices: DataFrame) -> DataFrame:
    """``(id, editorial_status)`` of papers with a notice ``(doi, notice)``: the severest of notice and status."""
    found = notices.select(X.normalise_doi(F.col("doi")).alias("doi"), X.editorial(F.col("notice")).alias("token")).where("token is not null")
    worst = found.groupBy("doi").agg(F.max(F.struct(X.severity(F.col("token")).alias("s"), "token"))["token"].alias("token"))
    j = papers.where("doi is not null").join(worst, "doi")
    return j.select("id", F.when(X.severity(F.col("token")) > X.severity(F.coalesce("editorial_status", F.lit(""))), F.col("token")).otherwise(F.col("editorial_status")).alias("editorial_status"))


def bulk_fill(papers: DataFrame, bulk: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Nulls filled from a bulk file by key; rows without anything useful are skipped first, first row of a key counts."""
    useful = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    one = bulk.where(useful & F.col(key).isNotNull()).groupBy(key).agg(*(F.min(F.when(F.col(f).isNotNull(), F.col(f))).alias(f"__{f}") for f in fields))
    out = papers.join(one, key, "left")
    return out.select(*(F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in papers.columns))


def map_join(rows: DataFrame, corpus: DataFrame, papers: DataFrame) -> DataFrame:
    """Bulk rows by corpus id to papers, through the map ``(corpusid, s2_id)``."""
    return rows.join(corpus, "corpusid").join(papers.where("s2_id is not null").select("s2_id", F.col("id").alias("paper_id")), "s2_id").drop("corpusid", "s2_id")


def ghost_stubs(pending: DataFrame, papers: DataFrame, least: int = 2) -> DataFrame:
    """``(ghost, degree, doi, s2_id)``: missing endpoints tied to ``least`` or more papers.

    Of the pending edges with exactly one end in the corpus the other end is a
    ghost, keyed by DOI, else by the other id; its ids are the largest seen.
    """
    ends = []
    known = papers.where("doi is not null").select(F.col("doi").alias("k"), F.col("id").alias("p")).unionAll(papers.where("s2_id is not null").select("s2_id", "id"))
    for side in ("citing", "cited"):
        ids = pending.select("id", F.explode(F.array_compact(F.array(f"{side}_doi", f"{side}_s2_id"))).alias("k"))
        ends.append(ids.join(known, "k").groupBy("id").agg(F.min("p").alias(f"{side}_paper")))
    both = pending.join(ends[0], "id", "left").join(ends[1], "id", "left")
    rows = []
    for inside, out in (("citing", "cited"), ("cited", "citing")):
        half = both.where(F.col(f"{inside}_paper").isNotNull() & F.col(f"{out}_paper").isNull())
        rows.append(half.select(F.col(f"{inside}_paper").alias("p"), F.col(f"{out}_doi").alias("doi"), F.col(f"{out}_s2_id").alias("s2_id")))
    g = rows[0].unionAll(rows[1]).withColumn("ghost", F.coalesce("doi", "s2_id")).where("ghost is not null")
    return g.groupBy("ghost").agg(F.countDistinct("p").alias("degree"), F.max("doi").alias("doi"), F.max("s2_id").alias("s2_id")).where(F.col("degree") >= least)


def duplicate_records(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, doi, s2_id, oa_id)``: the identifiers of both papers of a pair in one record, the first's before."""
    a, b = (papers.select(F.col("id").alias(n), *(F.col(k).alias(f"{n}_{k}") for k in KEYS)) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", *(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in KEYS))


def bib_ids(entries: DataFrame, papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``(key, id)``: the paper of every entry by DOI, else citekey, else a scheme's value, else PubMed id."""
    small = lambda d, k: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(f"__{k}"))
    out = entries.join(small(papers, "doi"), "doi", "left").join(small(papers, "citekey").withColumnRenamed("citekey", "key"), "key", "left")
    out = out.join(identifiers.groupBy("scheme", "value").agg(F.min("paper_id").alias("__scheme")), ["scheme", "value"], "left")
    out = out.join(small(papers, "pubmed_id"), "pubmed_id", "left")
    return out.select("key", F.coalesce("__doi", "__citekey", "__scheme", "__pubmed_id").alias("id")).where("id is not null").distinct()


def attempt_mask(attempts: DataFrame, bits: dict[tuple[str, str], int]) -> DataFrame:
    """``(paper_id, mask)``: bit of every (service, status) an attempt has."""
    bit = F.lit(0)
    for (service, status), k in bits.items():
        bit = F.when((F.col("service") == service) & (F.col("status") == status), F.lit(1 << k)).otherwise(bit)
    return attempts.groupBy("paper_id").agg(F.bit_or(bit).alias("mask"))


def scored_members(labels: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """Nodes of the clusters scored ``least`` or more."""
    return labels.join(scores.where(F.col("score") >= least), "cluster_id", "left_semi")


def visible_edges(edges: DataFrame, ghosts: DataFrame, citations: bool = True, show_ghosts: bool = False) -> DataFrame:
    """Edges to draw: none without citations; edges of ghosts only if they are shown."""
    if not citations:
        return edges.limit(0)
    if show_ghosts:
        return edges
    g = ghosts.select(F.col("id").alias("__g"))
    return edges.join(g, F.col("citing_id") == F.col("__g"), "left_anti").join(g, F.col("cited_id") == F.col("__g"), "left_anti")


def node_class(measure: str, nodes: DataFrame) -> DataFrame:
    """``(node_id, class)`` of a drawing mode: cluster, bridge, boundary band, tag or year."""
    value = {
        "cluster": F.when(F.col("cluster_id") < 0, "noise").otherwise(F.concat(F.lit("c"), F.col("cluster_id").cast("string"))),
        "bridge": F.when(F.col("span") >= 2, "bridge").otherwise("core"),
        "boundary": F.when(F.col("boundary") >= 0.5, "high").when(F.col("boundary") > 0, "some").otherwise("none"),
        "tag": F.coalesce("tag", F.lit("untagged")),
        "year": F.coalesce(F.col("year").cast("string"), F.lit("unknown")),
    }[measure]
    return nodes.select("node_id", value.alias("class"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``: correlation of ranks, ties at their mean rank.

    Ranks are running counts over distinct values, one row a value, not over rows.
    """

    def ranks(c: str) -> DataFrame:
        n = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        return n.select(c, (F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2).alias(f"__r_{c}"))

    return rows.join(ranks(a), a).join(ranks(b), b).agg(F.corr(f"__r_{a}", f"__r_{b}").alias("rho"))


def co_cluster_rate(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``pairs, together``: pairs ``(a, b)`` with both labelled, and those in one cluster."""
    x, y = (labels.where("cluster_id >= 0").select(F.col("node_id").alias(n), F.col("cluster_id").alias(f"c{n}")) for n in "ab")
    return pairs.join(x, "a").join(y, "b").agg(F.count("*").alias("pairs"), F.count_if(F.col("ca") == F.col("cb")).alias("together"))


def rewired(pairs: DataFrame, seed: int = 1) -> DataFrame:
    """The null model: the same first ends with the second ends dealt anew among pairs of one hash slot."""
    n = F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(64))
    slot = pairs.withColumn("s", n)
    left = slot.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("a", F.lit(seed)), "a", "b")))
    right = slot.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("b", F.lit(seed + 1)), "b", "a")))
    return left.select("s", "k", "a").join(right.select("s", "k", "b"), ["s", "k"]).select("a", "b").where("a <> b")


def settle_titles(items: DataFrame, works: DataFrame, own_ids: bool, least: float = 0.85) -> DataFrame:
    """``(paper_id, status, doi, s2_id, oa_id)`` of wanted titles; ``own_ids`` keeps the item's ids on the record."""
    from graphlens.operators.match import title_match

    hit = title_match(items.withColumnRenamed("paper_id", "idx").select("idx", "title"), works.select("id", "title"), least)
    j = items.join(hit.select(F.col("probe").alias("paper_id"), F.col("paper").alias("__w")), "paper_id", "left")
    w = works.select(F.col("id").alias("__w"), *(F.col(k).alias(f"__{k}") for k in KEYS))
    j = j.join(w, "__w", "left")
    ids = [F.coalesce(k, f"__{k}").alias(k) if own_ids else F.col(f"__{k}").alias(k) for k in KEYS]
    return j.select("paper_id", F.when(F.col("__doi").isNotNull(), "succeeded").otherwise("failed").alias("status"), *ids)


def settle_ids(items: DataFrame, works: DataFrame, key: str, need_doi: bool) -> DataFrame:
    """``(paper_id, status, doi)`` of wanted ids; a known id is enough unless a DOI is needed."""
    j = items.join(works.select(key, F.col("doi").alias("__doi"), F.lit(1).alias("__known")), key, "left")
    ok = F.col("__doi").isNotNull() if need_doi else F.col("__known").isNotNull()
    return j.select("paper_id", F.when(ok, "succeeded").otherwise("failed").alias("status"), F.col("__doi").alias("doi"))
