"""The guarded SQL surface: statement guard, row cap, guided builder, selectors, result text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: words that a read-only statement may not hold anywhere.
FORBIDDEN = "insert update delete drop alter create replace truncate attach detach pragma vacuum reindex merge".split()


class NotReadOnly(ValueError):
    """The statement is more than one SELECT."""


def check_select(sql: str) -> str:
    """The statement without comments if it is a single SELECT or WITH ... SELECT, else an error."""
    bare = re.sub(r"--[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/", " ", sql)).strip().rstrip(";").strip()
    if not bare:
        raise NotReadOnly("empty statement")
    if ";" in bare:
        raise NotReadOnly("one statement only")
    if not re.match(r"(?i)(select|with)\b", bare):
        raise NotReadOnly("only SELECT or WITH")
    hit = re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", bare)
    if hit:
        raise NotReadOnly(f"not allowed: {hit[1]}")
    return bare


def search(spark: SparkSession, sql: str, cap: int = 1000) -> tuple[DataFrame, bool]:
    """Rows of a checked statement, ``cap`` at most, and whether there were more.

    Without an order the rows that stay under the cap are any.
    """
    df = spark.sql(check_select(sql)).limit(cap + 1)
    df = df.cache()
    more = df.count() > cap
    return df.limit(cap), more


def guided(papers: DataFrame, edges: DataFrame, title: str | None = None, venue: str | None = None, year_from: int | None = None, year_to: int | None = None, kind: str | None = None, cited: int | None = None) -> DataFrame:
    """Papers by the guided form: substrings regardless of case, years, type, least number of citers."""
    out = papers
    for column, part in (("title", title), ("venue", venue)):
        if part:
            out = out.where(F.contains(F.lower(column), F.lower(F.lit(part))))
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("year") <= year_to)
    if kind:
        out = out.where(F.col("pub_type") == kind)
    if cited:
        deg = edges.groupBy(F.col("cited_id").alias("id")).agg(F.count("*").alias("__n")).where(F.col("__n") >= cited)
        out = out.join(deg, "id", "left_semi")
    return out


def guided_sql(title: str | None = None, year_from: int | None = None, year_to: int | None = None, venue: str | None = None, kind: str | None = None, cited: int | None = None) -> str:
    """The guided form as a statement; quotes are doubled."""
    q = lambda s: s.replace("'", "''")
    parts = []
    if title:
        parts.append(f"title ILIKE '%{q(title)}%'")
    if venue:
        parts.append(f"venue ILIKE '%{q(venue)}%'")
    if year_from is not None:
        parts.append(f"year >= {int(year_from)}")
    if year_to is not None:
        parts.append(f"year <= {int(year_to)}")
    if kind:
        parts.append(f"pub_type = '{q(kind)}'")
    if cited:
        parts.append(f"(SELECT COUNT(*) FROM citations c WHERE c.cited_id = p.id) >= {int(cited)}")
    return "SELECT p.id, p.title, p.year, p.venue FROM papers p" + (" WHERE " + " AND ".join(parts) if parts else "") + " ORDER BY p.id"


def selector(seeds: bool = False, everything: bool = False, year: int | None = None, ids: list[int] | None = None, where: str | None = None) -> Column:
    """The one predicate that is asked for; none or several are an error."""
    given = [seeds, everything, year is not None, ids is not None, where is not None]
    if sum(given) != 1:
        raise ValueError("give exactly one of seeds, everything, year, ids, where")
    if seeds:
        return F.col("is_seed") == 1
    if everything:
        return F.lit(True)
    if year is not None:
        return F.col("year") == year
    if ids is not None:
        return F.col("id").isin(*ids)
    return F.expr(where)


def row_filter(df: DataFrame, part: str) -> DataFrame:
    """Rows in which any column holds ``part`` regardless of case."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(part.lower())), F.lit(False))
    return df.where(hit)


def namespace_views(spark: SparkSession, datasets: dict[str, dict[str, DataFrame]]) -> None:
    """Each dataset's tables as views ``<alias>_<table>``; aliases are plain words."""
    for alias, tables in datasets.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", alias):
            raise ValueError(f"not a plain alias: {alias!r}")
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{alias}_{name}")


def result_text(df: DataFrame, form: str = "table", cap: int = 1000) -> str:
    """A capped result as an aligned table, JSON lines or CSV."""
    rows = df.limit(cap)
    if form == "json":
        return "\n".join(r[0] for r in rows.select(F.to_json(F.struct("*"))).collect())
    pdf = rows.toPandas()
    return pdf.to_csv(index=False) if form == "csv" else pdf.to_string(index=False)
