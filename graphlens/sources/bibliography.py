"""Bibliography files as DataFrames: RIS and BibTeX, read and written."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.functions import text as X

#: RIS tags that repeat, and what single tags mean.
RIS_LISTS = {"AU": "authors", "A1": "authors", "A2": "editors", "ED": "editors", "KW": "keywords"}
RIS_SCALARS = {"TY": "type", "TI": "title", "T1": "title", "T2": "venue", "JO": "venue", "JF": "venue", "PY": "year", "Y1": "year", "DA": "date", "AB": "abstract", "N2": "abstract", "DO": "doi", "UR": "url", "VL": "volume", "IS": "issue", "SP": "first_page", "EP": "last_page", "PB": "publisher", "SN": "serial", "LA": "language", "ID": "citekey"}
_LIST_COLS = sorted(set(RIS_LISTS.values()))
_COLS = sorted(set(RIS_SCALARS.values()))
RIS_SCHEMA = ", ".join([f"{c} string" for c in _COLS] + [f"{c} array<string>" for c in _LIST_COLS])


def parse_ris(text: str) -> list[dict]:
    """Records of a RIS text: the first value of a single tag stays, repeating tags collect, other lines are skipped."""
    out, rec = [], None
    for line in text.splitlines():
        m = re.match(r"^﻿?([A-Z][A-Z0-9])  -\s?(.*)$", line)
        if m is None:
            continue
        tag, value = m[1], m[2].strip()
        if tag == "TY":
            rec = {"type": value, **{c: [] for c in _LIST_COLS}}
        elif rec is None:
            continue
        elif tag == "ER":
            out.append(rec)
            rec = None
        elif tag in RIS_LISTS:
            if value:
                rec[RIS_LISTS[tag]].append(value)
        elif tag in RIS_SCALARS and value:
            rec.setdefault(RIS_SCALARS[tag], value)
    return out


def parse_bib(text: str) -> list[dict]:
    """Entries of a BibTeX text with balanced braces; strings, preambles and comments are skipped, first fields win."""
    out, at = [], 0
    while (m := re.compile(r"@\s*([A-Za-z]+)\s*([({])").search(text, at)) is not None:
        close = {"{": "}", "(": ")"}[m[2]]
        at = m.end()
        kind = m[1].lower()
        if kind in ("string", "preamble", "comment"):
            at = _balanced(text, m.end() - 1)
            continue
        key, at = _until(text, at, "," + close)
        entry = {"kind": kind, "key": key.strip(), "fields": {}}
        while at < len(text) and text[at] != close:
            at += 1
            name, at = _until(text, at, "=" + "," + close)
            if at >= len(text) or text[at] != "=":
                continue
            value, at = _value(text, at + 1, "," + close)
            if name.strip():
                entry["fields"].setdefault(name.strip().lower(), value)
        at += 1
        out.append(entry)
    return out


def _balanced(text: str, at: int) -> int:
    depth, opening = 0, text[at]
    close = {"{": "}", "(": ")"}[opening]
    while at < len(text):
        depth += (text[at] == opening) - (text[at] == close)
        at += 1
        if depth == 0:
            break
    return at


def _until(text: str, at: int, stops: str) -> tuple[str, int]:
    start = at
    while at < len(text) and text[at] not in stops:
        at += 1
    return text[start:at], at


def _value(text: str, at: int, stops: str) -> tuple[str, int]:
    parts = []
    while at < len(text) and text[at] not in stops:
        if text[at] == "{":
            end = _balanced(text, at)
            parts.append(text[at + 1 : end - 1])
            at = end
        elif text[at] == '"':
            start, depth = at + 1, 0
            at += 1
            while at < len(text) and (text[at] != '"' or depth or text[at - 1] == "\\"):
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
            parts.append(text[start:at])
            at += 1
        elif text[at].isspace() or text[at] == "#":
            at += 1
        else:
            start = at
            while at < len(text) and text[at] not in stops + "#" and not text[at].isspace():
                at += 1
            parts.append(text[start:at])
    return "".join(parts), at


def _files(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Whole files parsed one by one on the executors."""

    def run(batches):
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in parse(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return spark.read.text(path, wholetext=True).mapInArrow(run, schema)


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS files as raw records."""
    return _files(spark, path, parse_ris, RIS_SCHEMA)


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """BibTeX files as ``(kind, key, fields map<string,string>)`` with TeX cleaned."""
    clean = lambda t: [{**e, "fields": list({k: X.clean_tex(v) for k, v in e["fields"].items()}.items())} for e in parse_bib(t)]
    return _files(spark, path, clean, "kind string, key string, fields map<string,string>")


def ris_papers(records: DataFrame) -> DataFrame:
    """Paper columns of raw RIS records."""
    back = {v: k for k, v in reversed(X.RIS_TYPES.items())}
    serial = X.route_serial(X.map_type(F.col("type"), {k.lower(): v for k, v in back.items()}, "other"))
    return records.select(
        X.find_doi(F.coalesce("doi", "url")).alias("doi"), "title", "authors", "venue", X.year_of(F.coalesce("year", "date")).alias("year"),
        F.nullif(F.get(F.split("date", "/"), 1), F.lit("")).alias("month"), "abstract", "volume", "issue", "first_page", "last_page", "publisher",
        X.map_type(F.col("type"), {k.lower(): v for k, v in back.items()}, "other").alias("pub_type"),
        F.when(F.col("serial").isNotNull(), F.concat_ws(":", serial, "serial")).alias("serial"), "keywords",
    )


def bib_papers(entries: DataFrame) -> DataFrame:
    """Paper columns of BibTeX entries."""
    f = lambda k: F.element_at("fields", k)
    pages = X.split_pages(f("pages"))
    back = {v: k for k, v in reversed(X.BIB_TYPES.items())}
    return entries.select(
        F.col("key").alias("citekey"), X.normalise_doi(f("doi")).alias("doi"), f("title").alias("title"), X.split_names(f("author")).alias("authors"),
        F.coalesce(f("journal"), f("booktitle")).alias("venue"), X.year_of(F.coalesce(f("year"), f("date"))).alias("year"), f("volume").alias("volume"),
        pages["first"].alias("first_page"), pages["last"].alias("last_page"), f("publisher").alias("publisher"), X.map_type(F.col("kind"), back, "other").alias("pub_type"),
    )


def key_suffix(n: Column) -> Column:
    """Suffix of a key's nth use: none, a to z, then z1, z2 and so on."""
    return F.when(n == 1, "").when(n <= 27, F.char(F.lit(95) + n)).otherwise(F.concat(F.lit("z"), (n - 27).cast("string")))


def citekeys(papers: DataFrame) -> DataFrame:
    """``papers`` with ``citekey``: the stored one, else author, year and first title word, made unique.

    A synthesised key that repeats takes suffixes a to z, z1, z2 ... in id order,
    past keys that are stored.
    """
    author = F.regexp_replace(F.lower(F.coalesce(F.get(F.split(F.get("authors", 0), ","), 0), F.lit("anon"))), "[^a-z0-9]", "")
    word = F.get(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) > 3), 0)
    base = F.concat(author, F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.coalesce(word, F.lit("")))
    p = papers.withColumn("__base", F.when(F.col("citekey").isNull(), base))
    stored = papers.where("citekey is not null").select(F.col("citekey").alias("__base"), F.lit(1).alias("__taken")).distinct()
    w = Window.partitionBy("__base").orderBy("id")
    p = p.join(stored, "__base", "left").withColumn("__n", F.row_number().over(w) + F.coalesce("__taken", F.lit(0)))
    suffix = key_suffix(F.col("__n"))
    return p.withColumn("citekey", F.coalesce("citekey", F.concat("__base", suffix))).drop("__base", "__taken", "__n")


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_])", r"\\$1")


def keywords(tags: DataFrame, prefixes: bool = False) -> DataFrame:
    """``(paper_id, keywords)``: distinct tags in order, with their category before them on request."""
    word = F.when(F.col("category").isNotNull() & F.lit(prefixes), F.concat_ws(":", "category", "tag")).otherwise(F.col("tag"))
    return tags.groupBy("paper_id").agg(F.array_sort(F.collect_set(word)).alias("keywords"))


def exportable(papers: DataFrame, redacted: bool = False) -> DataFrame:
    """Papers without retracted and withdrawn ones unless asked for."""
    return papers if redacted else papers.where(F.col("editorial_status").isNull() | ~F.col("editorial_status").isin("retracted", "withdrawn"))


def to_bibtex(papers: DataFrame) -> DataFrame:
    """``(id, value)``: one BibTeX entry a paper; the container's field follows the type."""
    kind = X.map_type(F.col("pub_type"), X.BIB_TYPES, "misc")
    has = lambda c: c in papers.columns
    col = lambda c: F.col(c) if has(c) else F.lit(None).cast("string")
    pages = F.concat_ws("--", col("first_page"), col("last_page"))
    line = lambda name, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {name} = {{"), v, F.lit("},")))
    container = F.when(kind.isin("incollection", "inproceedings"), line("booktitle", _escape(col("venue")))).otherwise(line("journal", _escape(col("venue"))))
    lines = [
        line("title", _escape(F.col("title"))), line("author", _escape(F.array_join("authors", " and "))), line("year", F.col("year").cast("string")), container,
        line("volume", col("volume")), line("number", col("issue")), line("pages", pages), line("publisher", _escape(col("publisher"))), line("doi", col("doi")),
        line("keywords", _escape(F.array_join("keywords", ", ")) if has("keywords") else F.lit(None).cast("string")),
    ]
    return papers.select("id", F.concat(F.lit("@"), kind, F.lit("{"), "citekey", F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n}\n")).alias("value"))


def to_ris(papers: DataFrame) -> DataFrame:
    """``(id, value)``: one RIS record a paper."""
    kind = X.map_type(F.col("pub_type"), X.RIS_TYPES, "GEN")
    col = lambda c: F.col(c) if c in papers.columns else F.lit(None).cast("string")
    line = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{tag}  - "), v))
    many = lambda tag, c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{tag}  - "), x)), "\n"))
    lines = [
        line("TY", kind), line("TI", F.col("title")), many("AU", F.col("authors")), line("PY", F.col("year").cast("string")), line("T2", col("venue")), line("VL", col("volume")),
        line("IS", col("issue")), line("SP", col("first_page")), line("EP", col("last_page")), line("PB", col("publisher")), line("DO", col("doi")),
        many("KW", F.col("keywords")) if "keywords" in papers.columns else F.lit(None).cast("string"), F.lit("ER  - "),
    ]
    return papers.select("id", F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n")).alias("value"))


def write_text(entries: DataFrame, path: str) -> None:
    """Entries as text files in the path's file system."""
    entries.select("value").write.mode("overwrite").text(path)
