"""Operator 2: URL filters, curated rules first, mined association rules for the rest.

Built-in column functions and Spark's FP-growth only. A URL becomes a set of
tokens: every label of its host with its place from the right, so that a host
suffix is a combination of tokens, its path words and pairs of host and first
path word; numbers are one token. FP-growth mines token combinations of
the labelled URLs together with their label; a rule "tokens -> label" is kept from a
confidence and a support on, and dropped where a rule with fewer of its tokens
says the same with as much confidence. Rules match by an inverted index on
each rule's rarest token, followed by a subset test; the rule with the highest
confidence, then support, then most tokens, then first by name, decides. No rule: allow.

Edge cases: null URLs and URLs without "://" have empty host and path, no rule
and the default verdict; empty and very long URLs are split whole; repeated rows
are judged alike; with no labels nothing is mined; an empty table gives an
empty result; other columns are ignored by ``judge``, which returns one row a page.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import cut, join_by_key, small_side, table

#: The contract's rules: host, path prefix, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Label items; a token can't equal them, tokens hold a kind and a colon.
ALLOW, BLOCK = "=allow", "=block"


def host_of(url: Column) -> Column:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: after the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def curated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels by place, path words, host with first path word."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    placed = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit(":"), x))
    words = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: x != "")
    words = F.array_distinct(F.transform(words, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))))
    both = F.when((n > 0) & (F.size(words) > 0), F.array(F.concat(F.lit("b:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."), F.lit("/"), F.get(words, 0))))
    empty = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.concat(placed, words, F.coalesce(both, empty)))


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.6) -> DataFrame:
    """Rules ``(rule, items, verdict, confidence, support, anchor)`` from ``labelled(items, blocked)``.

    ``anchor`` is the rule's rarest token, the one the inverted index keeps it under.
    """
    baskets = labelled.where("items is not null and blocked is not null and size(items) > 0")
    baskets = cut(baskets.select(F.concat("items", F.array(F.when(F.col("blocked"), BLOCK).otherwise(ALLOW))).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.size("consequent") == 1).where(F.col("consequent")[0].isin(ALLOW, BLOCK))
    rules = rules.where(~F.arrays_overlap("antecedent", F.array(F.lit(ALLOW), F.lit(BLOCK))))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
    rules = cut(rules.withColumn("rule", F.array_join("items", " ")))
    # drop a rule where one with a token less says the same as surely
    less = rules.select("rule", "verdict", "confidence", "items", F.explode("items").alias("x"))
    less = less.withColumn("shorter", F.array_join(F.array_remove("items", F.col("x")), " ")).select("rule", "verdict", "confidence", "shorter")
    known = rules.select(F.col("rule").alias("shorter"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    worse = less.join(known, "shorter").where("v = verdict and c >= confidence").select("rule", "verdict").distinct()
    rules = rules.join(worse, ["rule", "verdict"], "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ranked = rules.select("rule", "verdict", F.explode("items").alias("token")).join(counts, "token")
    anchors = ranked.groupBy("rule", "verdict").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return cut(rules.join(anchors, ["rule", "verdict"]))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", index_rows: int = 20_000) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined)``: the curated rule, else the best mined one, else ``default``.

    Equal token sets are judged once, and the sets of many pages are brought
    back to them by broadcast. The index is broadcast up to ``index_rows`` rules,
    joined by shuffle beyond.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = curated(F.col("host"), F.col("path"))
    base = base.select("*", name.alias("rule"), verdict.alias("__curated"), tokens(F.col("host"), F.col("path")).alias("__items"))
    index = rules.select("anchor", F.col("items").alias("need"), F.col("rule").alias("name"), F.col("verdict").alias("says"), "confidence", "support")
    sets = cut(base.where("__curated is null").groupBy("__items").agg(F.count("*").alias("__n")))
    asked = sets.select("__items", F.explode("__items").alias("anchor"))
    hits = asked.join(small_side(index, index_rows), "anchor").where(F.size(F.array_except("need", "__items")) == 0)
    order = F.struct(F.col("confidence"), F.col("support"), F.size("need").alias("size"), F.col("says").alias("says"), F.col("name").alias("name"))
    best = hits.groupBy("__items").agg(F.max(order).alias("best")).select("__items", F.col("best.says").alias("__says"), F.col("best.name").alias("mined"))
    out = join_by_key(base, cut(sets.join(best, "__items", "left")), ["__items"], "__n")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__curated", "__says", F.lit(default)).alias("verdict"), F.when(F.col("__curated").isNull(), F.col("mined")).alias("mined"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the pages that have a label (by id); low quality or toxic means blocked."""
    mark = labels.select(F.col("doc_id").cast("long").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), tokens(host_of(F.col("url")), path_of(F.col("url"))).alias("items"))
    return base.join(mark, "page_id").select("items", "blocked")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, mine(labelled_pages(pages, table(spark, sf_dir, "labels"))))
