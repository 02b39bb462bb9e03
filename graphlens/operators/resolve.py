"""Field resolution, merge plans and conflict reports over source observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.functions import text as X

#: Fixed value: resolution class of each field.
FIELD_CLASS = {"title": "representational", "venue": "representational", "pub_type": "representational", "year": "authoritative", "publication_date": "authoritative", "volume": "authoritative", "issue": "authoritative", "editorial_status": "observational"}
IDENTIFIERS = ("doi", "s2_id", "oa_id")


def latest(observations: DataFrame) -> DataFrame:
    """Latest observation of each (paper, field, source)."""
    w = Window.partitionBy("paper_id", "field", "source").orderBy(F.desc("observed_at"), "value")
    return observations.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve_fields(observations: DataFrame) -> DataFrame:
    """``(paper_id, field, value, conflict)`` of every observed field.

    Representational: equal canonical keys take the longest display; else the
    most trusted source wins. Authoritative: non-preprints only where there are
    any, then trust. In both a conflict is the first differing observation, in
    order of trust, having the winner's rank. Editorial status: the severest
    token, never a conflict. Ties: source name, then time.
    """
    kinds = F.create_map(*(F.lit(x) for kv in FIELD_CLASS.items() for x in kv))
    o = latest(observations).where("value is not null")
    o = o.withColumn("cls", F.coalesce(F.element_at(kinds, F.col("field")), F.lit("authoritative")))
    o = o.withColumn("rank", X.trust(F.col("source"))).withColumn("key", X.canonical(F.col("field"), F.col("value")))
    group = Window.partitionBy("paper_id", "field")
    published = F.max((F.coalesce(F.col("pub_type_hint"), F.lit("")) != "preprint").cast("int")).over(group)
    o = o.withColumn("pub", published)
    o = o.where((F.col("cls") != "authoritative") | (F.col("pub") == 0) | (F.coalesce(F.col("pub_type_hint"), F.lit("")) != "preprint"))
    entry = F.struct("rank", "source", "observed_at", "key", "value")
    g = o.groupBy("paper_id", "field", "cls").agg(
        F.min(entry).alias("top"),
        F.countDistinct("key").alias("keys"),
        F.max(F.struct(F.length("value").alias("n"), (-F.col("rank")).alias("r"), "value"))["value"].alias("longest"),
        F.max(F.struct(X.severity(F.col("key")).alias("s"), "key"))["key"].alias("severest"),
        F.collect_set(F.struct("rank", "source", "observed_at", "key")).alias("all"),
    )
    differing = F.filter(F.array_sort("all"), lambda x: x["key"] != F.col("top.key"))
    clash = F.coalesce(F.get(differing, 0)["rank"] == F.col("top.rank"), F.lit(False))
    value = F.when(F.col("cls") == "observational", F.col("severest")).when((F.col("cls") == "representational") & (F.col("keys") == 1), F.col("longest")).otherwise(F.col("top.value"))
    return g.select("paper_id", "field", value.alias("value"), (clash & (F.col("cls") != "observational")).alias("conflict"))


def live_conflicts(observations: DataFrame) -> DataFrame:
    """``(field, n)``: papers in conflict by field; years and dates count any disagreement."""
    o = latest(observations).where("value is not null")
    several = o.groupBy("paper_id", "field").agg(F.countDistinct("source").alias("s"), F.countDistinct("value").alias("v")).where("s > 1")
    loud = several.where("field in ('year', 'publication_date') and v > 1").select("paper_id", "field")
    rest = resolve_fields(observations).where("conflict and field not in ('year', 'publication_date')").select("paper_id", "field")
    return loud.unionAll(rest).groupBy("field").agg(F.count("*").alias("n"))


def merge_plan(members: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Winner of each component with its fills and conflicts.

    ``members(component, id, <identifiers>, <fields>)``. The winner has most
    columns filled, then the smallest id. Missing identifiers are transplanted
    and missing fields filled from the losers in id order; a loser's different
    identifier is a conflict and changes nothing.
    """
    cols = [c for c in IDENTIFIERS + tuple(fields) if c in members.columns]
    m = members.withColumn("__filled", X.populated(*cols))
    w = Window.partitionBy("component").orderBy(F.desc("__filled"), "id")
    m = m.withColumn("__n", F.row_number().over(w)).withColumn("winner", F.first("id").over(w))
    aggs = []
    for c in cols:
        own = F.max(F.when(F.col("__n") == 1, F.col(c)))
        fill = F.min(F.when((F.col("__n") > 1) & F.col(c).isNotNull(), F.struct("id", F.col(c).alias("v"))))["v"]
        aggs.append(F.coalesce(own, fill).alias(c))
        if c in IDENTIFIERS:
            wins = F.max(F.when(F.col("__n") == 1, F.col(c)))
            aggs += [wins.alias(f"__own_{c}"), F.collect_set(F.when(F.col("__n") > 1, F.col(c))).alias(f"__lost_{c}")]
    g = m.groupBy("component", "winner").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.when(F.col("__n") > 1, F.col("id")))).alias("losers"), *aggs)
    def clash(c: str):
        other = F.filter(F.array_sort(f"__lost_{c}"), lambda v: F.col(f"__own_{c}").isNotNull() & (v != F.col(f"__own_{c}")))
        return F.transform(other, lambda v: F.concat_ws(":", F.lit(c), F.col(f"__own_{c}"), v))

    clashes = [clash(c) for c in IDENTIFIERS if c in cols]
    return g.select("component", "winner", "members", "losers", *cols, (F.concat(*clashes) if clashes else F.array()).alias("conflicts"))


def apply_merges(papers: DataFrame, plan: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Papers after the merges (losers tombstoned, without identifiers) and the new aliases."""
    cols = [c for c in IDENTIFIERS + tuple(fields) if c in papers.columns]
    aliases = plan.select(F.explode("losers").alias("loser_id"), F.col("winner").alias("winner_id"))
    new = plan.where("members > 1").select(F.col("winner").alias("__w"), *(F.col(c).alias(f"__{c}") for c in cols))
    won = papers.join(new, papers["id"] == new["__w"], "left").join(aliases.select(F.col("loser_id").alias("__l")), papers["id"] == F.col("__l"), "left")
    lost = F.col("__l").isNotNull()
    out = []
    for c in papers.columns:
        v = F.coalesce(F.col(c), F.col(f"__{c}")) if c in cols else F.col(c)
        v = F.when(lost, F.lit(None)).otherwise(v) if c in IDENTIFIERS else v
        out.append((F.when(lost, F.lit(1)).otherwise(v) if c == "tombstone" else v).alias(c))
    return won.select(*out), aliases


def merge_author_lists(lists: list[list[str]]) -> list[str]:
    """One author list: the longest is the base, others that share a name add fuller forms and new people."""
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if not lists:
        return []
    out = list(lists[0])
    base_tokens = {t for n in out for t in X.name_tokens(n)}
    for other in lists[1:]:
        if not base_tokens & {t for n in other for t in X.name_tokens(n)}:
            continue
        for name in other:
            at = next((i for i, n in enumerate(out) if X.same_person(n, name)), None)
            if at is None:
                out.append(name)
            elif sum(len(t) > 1 for t in X.name_tokens(name)) > sum(len(t) > 1 for t in X.name_tokens(out[at])):
                out[at] = name
    return out


def resolve_authors(observations: DataFrame) -> DataFrame:
    """``(paper_id, authors)`` from ``observations(paper_id, source, authors array<string>)``."""
    merged = F.pandas_udf(lambda s: s.map(lambda ls: merge_author_lists([list(x) for x in ls])), T.ArrayType(T.StringType()))
    rows = observations.withColumn("rank", X.trust(F.col("source")))
    g = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "authors"))).alias("ls"))
    return g.select("paper_id", merged(F.transform("ls", lambda x: x["authors"])).alias("authors"))


def upsert_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts by (paper, source): a new non-null value wins, else the old one stays. ``new`` has ``seq``."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"].alias(c)
    return rows.withColumn("source", X.count_bucket(F.col("source"))).groupBy("paper_id", "source").agg(last("cit_count"), last("ref_count"))


def keep_longer(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Longest text of each key, the first in ``order`` among equals."""
    best = F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("o"), F.col(text).alias("t")))["t"]
    return rows.where(F.col(text).isNotNull()).groupBy(key).agg(best.alias(text))


def conflict_log(resolved: DataFrame, observations: DataFrame, now: str) -> DataFrame:
    """Rows for the conflict log: every observed value that differs from a conflicted field's value."""
    o = latest(observations).where("value is not null").select("paper_id", "field", F.col("value").alias("proposed_value"), F.col("source").alias("proposed_source"))
    hit = resolved.where("conflict").select("paper_id", "field", F.col("value").alias("existing_value"))
    return o.join(hit, ["paper_id", "field"]).where("proposed_value <> existing_value").withColumn("discovered_at", F.to_timestamp(F.lit(now)))
