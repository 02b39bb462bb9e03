"""Matching records to papers on several identifiers, and by title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.text import normalise_title, title_ratio

KEYS = ("doi", "s2_id", "oa_id")


def multi_key_match(probes: DataFrame, papers: DataFrame, keys=KEYS, probe_id: str = "idx", paper_id: str = "id") -> DataFrame:
    """``(probe, paper, matched_on)``: pairs that share any key, once, with the first key that matches.

    A disjunctive join would be a nested loop; the union of one equi-join per
    key is hashed, and null keys never match.
    """
    sides = []
    for rank, k in enumerate(keys):
        p = probes.where(F.col(k).isNotNull()).select(F.col(probe_id).alias("probe"), F.col(k).alias("__k"))
        q = papers.where(F.col(k).isNotNull()).select(F.col(paper_id).alias("paper"), F.col(k).alias("__k"))
        sides.append(p.join(q, "__k").select("probe", "paper", F.lit(rank).alias("rank")))
    best = reduce(DataFrame.unionAll, sides).groupBy("probe", "paper").agg(F.min("rank").alias("rank"))
    return best.select("probe", "paper", F.element_at(F.array(*(F.lit(k) for k in keys)), F.col("rank") + 1).alias("matched_on"))


def priority_match(probes: DataFrame, papers: DataFrame, keys=KEYS, probe_id: str = "idx", paper_id: str = "id") -> DataFrame:
    """``(probe, paper)``: the paper found by the first key that finds any (smallest id), else null."""
    found = multi_key_match(probes, papers, keys, probe_id, paper_id)
    rank = F.array_position(F.array(*(F.lit(k) for k in keys)), F.col("matched_on"))
    best = found.groupBy("probe").agg(F.min(F.struct(rank.alias("r"), "paper"))["paper"].alias("paper"))
    return probes.select(F.col(probe_id).alias("probe")).join(best, "probe", "left")


def classify(matches: DataFrame, probes: DataFrame, roots: DataFrame | None = None, probe_id: str = "idx") -> DataFrame:
    """``(probe, kind, hits, target)``: new, single or multi by the number of canonical papers hit."""
    if roots is not None:
        matches = matches.join(roots, matches["paper"] == roots["loser_id"], "left").withColumn("paper", F.coalesce("root_id", "paper"))
    hits = matches.groupBy("probe").agg(F.countDistinct("paper").alias("hits"), F.min("paper").alias("target"))
    out = probes.select(F.col(probe_id).alias("probe")).join(hits, "probe", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    kind = F.when(F.col("hits") == 0, "new").when(F.col("hits") == 1, "single").otherwise("multi")
    return out.select("probe", kind.alias("kind"), "hits", "target")


def identity_edges(records: DataFrame, keys=KEYS, record_id: str = "idx") -> DataFrame:
    """``(src, dst)``: each record tied to the first record with the same identifier value.

    A star per value: linear in the rows however many share a value. Input of
    the connected components that merge records across all identifiers.
    """
    ids = reduce(DataFrame.unionAll, [records.where(F.col(k).isNotNull()).select(F.col(record_id).alias("src"), F.lit(k).alias("k"), F.col(k).alias("v")) for k in keys])
    first = ids.groupBy("k", "v").agg(F.min("src").alias("dst"))
    return ids.join(first, ["k", "v"]).select("src", "dst").where("src <> dst").distinct()


def title_match(probes: DataFrame, papers: DataFrame, least: float = 0.85, hits: int = 3, same_year: bool = False, frequent: int = 1000) -> DataFrame:
    """``(probe, paper, ratio)``: best title of at least ``least`` similarity among ``hits`` candidates.

    Candidates share a rare word: words are blocked by document frequency and
    each probe title looks up its rarest ones. Equal titles are joined first and
    papers of one title count once. A probe whose words all occur in more than
    ``frequent`` titles is compared with every title of fitting length that
    shares one of them.
    ``probes(idx, title[, year])``, ``papers(id, title[, year])``.
    """
    q = papers.select(F.col("id").alias("paper"), normalise_title("title").alias("pt"), *([F.col("year").alias("py")] if same_year else []))
    p = probes.select(F.col("idx").alias("probe"), normalise_title("title").alias("qt"), *([F.col("year").alias("qy")] if same_year else []))
    year = ["py"] if same_year else []
    q = q.where("length(pt) > 0").groupBy("pt", *year).agg(F.min("paper").alias("paper"))
    fits = (lambda d: d.where("qy is null or py is null or qy = py")) if same_year else (lambda d: d)
    equal = fits(p.join(q, F.col("qt") == F.col("pt"))).groupBy("probe").agg(F.min("paper").alias("paper"))
    p = p.join(equal.select("probe"), "probe", "left_anti")
    words = lambda d, i, t: d.select(i, F.explode(F.array_distinct(F.split(t, " "))).alias("w")).where("length(w) > 2")
    held = words(q, "paper", "pt")
    rare = held.groupBy("w").agg(F.count("*").alias("df"))
    w = Window.partitionBy("probe").orderBy("df", "w")
    asked = words(p, "probe", "qt").join(rare, "w").withColumn("n", F.row_number().over(w)).where("n <= 4").withColumn("least", F.min("df").over(Window.partitionBy("probe")))
    shared = asked.join(held, "w").groupBy("probe", "paper").agg(F.sum(1 / F.col("df")).alias("weight"), F.min("least").alias("least"))
    top = Window.partitionBy("probe").orderBy(F.desc("weight"), "paper")
    pairs = shared.withColumn("n", F.row_number().over(top)).where((F.col("n") <= hits) | (F.col("least") > frequent))
    shorter, longer = F.least(F.length("qt"), F.length("pt")), F.greatest(F.length("qt"), F.length("pt"))
    near = fits(pairs.drop("least").join(p, "probe").join(q, "paper")).where(2 * shorter >= (least - 1e-9) * (shorter + longer))
    scored = near.withColumn("ratio", title_ratio("qt", "pt")).where(F.col("ratio") >= least)
    best = scored.groupBy("probe").agg(F.max(F.struct("ratio", (-F.col("paper")).alias("p"))).alias("b"))
    near = best.select("probe", (-F.col("b.p")).alias("paper"), F.col("b.ratio").alias("ratio"))
    return near.unionAll(equal.select("probe", "paper", F.lit(1.0).alias("ratio")).where(F.lit(least <= 1)))


def title_year_pairs(papers: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: equal title and year, an identifier present on one side only."""
    one = papers.where("title is not null and year is not null and tombstone = 0")
    a, b = (one.select(F.col("id").alias(n), "title", "year", *(F.col(k).isNull().alias(f"{n}_{k}") for k in KEYS)) for n in "ab")
    odd = reduce(lambda x, y: x | y, [F.col(f"a_{k}") != F.col(f"b_{k}") for k in KEYS])
    return a.join(b, ["title", "year"]).where("a < b").where(odd).select("a", "b")
