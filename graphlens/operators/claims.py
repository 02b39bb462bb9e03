"""Enrichment candidates, needs, claims and routing."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.components import number_rows

#: Endpoint, service, provider, batch size, fields, precondition.
CATALOGUE = [
    ("enrich_metadata_oa", "oa", "openalex", 50, ("abstract", "authors", "venue", "year", "pub_type"), "doi is not null and is_seed = 1"),
    ("enrich_metadata_s2", "s2_live", "s2", 500, ("abstract", "authors", "venue", "year", "pub_type"), "doi is not null and is_seed = 1"),
    ("enrich_metadata_ncbi", "ncbi", "ncbi", 200, ("abstract", "title", "year"), "(pubmed_id is not null or doi is not null) and is_seed = 1"),
    ("enrich_biblio_crossref", "crossref", "crossref", 20, ("volume", "first_page", "publisher"), "doi is not null and is_seed = 1"),
    ("enrich_stubs_oa", "oa", "openalex", 50, ("_all",), "oa_id is not null and title is null"),
    ("resolve_dois_oa", "oa", "openalex", 50, ("_all",), "doi is null and title is not null"),
    ("resolve_dois_s2", "s2_live", "s2", 500, ("_all",), "doi is null and title is not null"),
    ("resolve_dois_via_pmid", "ncbi_pmid", "ncbi", 200, ("_all",), "pubmed_id is not null and doi is null"),
    ("resolve_dois_via_s2id", "s2_live", "s2", 500, ("_all",), "s2_id is not null and doi is null"),
    ("expand_papers_s2", "s2_hop", "s2", 500, ("_all",), "doi is not null or s2_id is not null"),
    ("expand_incoming_oa", "oa_incoming", "openalex", 25, ("cites",), "oa_id is not null and is_seed = 1"),
    ("expand_papers_s2_seeds", "s2_hop", "s2", 500, ("_all",), "(doi is not null or s2_id is not null) and is_seed = 1"),
]
CLAIM_MINUTES, RETRY_DAYS = 60, 180


def presence_mask(columns: list[str]) -> Column:
    """Bit k set where the k-th column is not null."""
    return sum((F.when(F.col(c).isNotNull(), F.lit(1 << k)).otherwise(0) for k, c in enumerate(columns)), F.lit(0))


def need_flags(columns: list[str]) -> list[Column]:
    """A 0/1 column per field that is null."""
    return [F.col(c).isNull().cast("int").alias(f"need_{c}") for c in columns]


def blocking(attempts: DataFrame, now: str, reader_rule: bool = True) -> DataFrame:
    """``(paper_id, service, field)`` with an attempt that rules out another one.

    Succeeded; failed within the retry window; claimed within the claim window
    (``reader_rule``) or claimed at all.
    """
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("claimed_at").cast("timestamp").cast("long")
    fresh = (F.col("status") == "claimed") & ((age < CLAIM_MINUTES * 60) if reader_rule else F.lit(True))
    rule = (F.col("status") == "succeeded") | fresh | ((F.col("status") == "failed") & (age < RETRY_DAYS * 86400))
    return attempts.where(rule).select("paper_id", "service", "field").distinct()


def _columns(papers: DataFrame) -> DataFrame:
    known = {f for row in CATALOGUE for f in row[4]} - {"_all", "cites"}
    return papers.select("*", *(F.lit(None).cast("string").alias(c) for c in sorted(known) if c not in papers.columns))


def needs(papers: DataFrame, attempts: DataFrame, now: str, reader_rule: bool = True) -> DataFrame:
    """``(paper_id, endpoint, service, field)``: open needs of every paper at every endpoint."""
    p = _columns(papers).where("is_rejected = 0")
    parts = []
    for endpoint, service, _, _, fields, when in CATALOGUE:
        open_ = F.array(*(F.when(F.lit(True) if f in ("_all", "cites") else F.col(f).isNull(), F.lit(f)) for f in fields))
        parts.append(p.where(when).select(F.col("id").alias("paper_id"), F.lit(endpoint).alias("endpoint"), F.lit(service).alias("service"), F.explode(F.array_compact(open_)).alias("field")))
    return reduce(DataFrame.unionAll, parts).join(blocking(attempts, now, reader_rule), ["paper_id", "service", "field"], "left_anti").select("paper_id", "endpoint", "service", "field")


def remaining(open_needs: DataFrame) -> DataFrame:
    """Papers left per endpoint."""
    return open_needs.groupBy("endpoint").agg(F.countDistinct("paper_id").alias("papers"))


def claim(papers: DataFrame, open_needs: DataFrame, endpoint: str, limit: int) -> DataFrame:
    """The next papers of an endpoint: seeds, most discovered, (title searches: longest title,) smallest id."""
    order = [F.desc("is_seed"), F.desc("discovery_count"), *([F.desc(F.length("title"))] if endpoint in ("resolve_dois_oa", "resolve_dois_s2") else []), F.asc("id")]
    wanted = open_needs.where(F.col("endpoint") == endpoint).select(F.col("paper_id").alias("id")).distinct()
    return papers.join(wanted, "id", "left_semi").orderBy(*order).limit(limit)


def unclaimed_elsewhere(candidates: DataFrame, attempts: DataFrame, service: str, now: str) -> DataFrame:
    """Candidates that no other service has claimed of late."""
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("claimed_at").cast("timestamp").cast("long")
    busy = attempts.where((F.col("status") == "claimed") & (age < CLAIM_MINUTES * 60) & (F.col("service") != service))
    return candidates.join(busy, candidates["id"] == busy["paper_id"], "left_anti")


def current_state(attempts: DataFrame, now: str, expire: bool = True) -> DataFrame:
    """Latest attempt of each (paper, service, field); stale claims become failures on request."""
    w = Window.partitionBy("paper_id", "service", "field").orderBy(F.desc("claimed_at"), F.desc("attempt_id"))
    last = attempts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if not expire:
        return last
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("claimed_at").cast("timestamp").cast("long")
    return last.withColumn("status", F.when((F.col("status") == "claimed") & (age >= CLAIM_MINUTES * 60), "failed").otherwise(F.col("status")))


def mark(attempts: DataFrame, keys: DataFrame, status: str, now: str) -> DataFrame:
    """The attempt log with a new row of ``status`` for every ``(paper_id, service, field)``.

    ``released`` takes the claims away instead: the log without the keys' claimed rows.
    """
    on = ["paper_id", "service", "field"]
    if status == "released":
        held = attempts.where("status = 'claimed'").join(keys, on, "left_semi")
        return attempts.join(held, ["attempt_id"], "left_anti")
    top = attempts.agg(F.coalesce(F.max("attempt_id"), F.lit(0)).alias("top"))
    rows = number_rows(keys.select(*on).distinct(), on, "n").crossJoin(F.broadcast(top))  # top is one row
    new = rows.select(*on, F.lit(status).alias("status"), F.to_timestamp(F.lit(now)).alias("claimed_at"), (F.col("top") + F.col("n") + 1).alias("attempt_id"))
    return attempts.withColumn("claimed_at", F.col("claimed_at").cast("timestamp")).unionByName(new)


def route(open_needs: DataFrame, calls: dict[str, int] | None = None) -> DataFrame:
    """``(paper_id, endpoint, step)``: a greedy cover of every paper's needs, within provider budgets.

    Papers with the same set of needs share one solution, so the greedy loop runs
    once a signature, not once a paper. Most needs covered first; ties: largest
    batch, then largest name. ``calls`` bounds a provider's papers at calls x batch.
    """
    sizes = {e: b for e, _, _, b, _, _ in CATALOGUE}
    per = open_needs.groupBy("paper_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "endpoint", "service", "field"))).alias("sig"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sig in pdf["sig"]:
            offers: dict[str, set] = {}
            for x in sig:
                endpoint, service, field = x.split("|")
                offers.setdefault(endpoint, set()).add(field if field in ("_all", "cites") else f"meta:{field}")
                if field in ("_all", "cites"):
                    offers[endpoint] = offers[endpoint] - {field} | {f"{service}:{field}"}
            left = set().union(*offers.values())
            chosen = []
            while left:
                best = max(offers, key=lambda e: (len(offers[e] & left), sizes[e], e))
                if not offers[best] & left:
                    break
                chosen.append(best)
                left -= offers[best]
            out.append(chosen)
        return pd.DataFrame({"sig": pdf["sig"], "cover": out})

    signatures = per.select("sig").distinct()
    solved = signatures.mapInPandas(lambda it: (solve(p) for p in it), "sig array<string>, cover array<string>")
    plan = per.join(solved, "sig").select("paper_id", F.posexplode("cover").alias("step", "endpoint"))
    if not calls:
        return plan.select("paper_id", "endpoint", "step")
    rows = [(e, p, b, calls.get(p)) for e, _, p, b, _, _ in CATALOGUE]
    caps = plan.sparkSession.createDataFrame(rows, "endpoint string, provider string, batch long, calls long")
    w = Window.partitionBy("provider", "endpoint").orderBy("paper_id")
    ranked = plan.join(F.broadcast(caps), "endpoint").withColumn("call", F.floor((F.row_number().over(w) - 1) / F.col("batch")))
    used = ranked.select("provider", "endpoint", "call").distinct()
    used = used.withColumn("nth", F.row_number().over(Window.partitionBy("provider").orderBy("endpoint", "call")))
    return ranked.join(used, ["provider", "endpoint", "call"]).where("calls is null or nth <= calls").select("paper_id", "endpoint", "step")


def order_columns(text: str, allowed: list[str]) -> list[Column]:
    """Columns of an ORDER BY text; anything but allowed names with ASC or DESC is an error."""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)(?:\s+(ASC|DESC))?\s*", part, re.I)
        if m is None or m[1] not in allowed:
            raise ValueError(f"not an allowed order: {part.strip()!r}")
        out.append(F.col(m[1]).desc_nulls_last() if (m[2] or "").upper() == "DESC" else F.col(m[1]).asc_nulls_first())
    return out


def parity(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in ``a`` and rows only in ``b``, as sets."""
    return a.distinct().subtract(b), b.distinct().subtract(a)
