"""Connected components, alias resolution and compaction of the citation graph."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; in local mode one of our own where none is set."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def iterate_until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], state: Callable[[DataFrame], tuple], limit: int = 100) -> DataFrame:
    """Apply ``step`` until ``state`` (a small aggregate) repeats; the lineage is cut each round."""
    df = cut(df)
    seen = state(df)
    for _ in range(limit):
        df = cut(step(df))
        now = state(df)
        if now == seen:
            return df
        seen = now
    raise RuntimeError(f"not stable after {limit} rounds")


def _digest(*cols: str) -> Callable[[DataFrame], tuple]:
    return lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` with the smallest node id as name; alternating large and small stars."""

    def rounds(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        return large.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()

    start = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    stars = iterate_until_stable(start, rounds, _digest("u", "v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select("v", "v").distinct())


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in ``order``, without a global sort in one task.

    Ranges are numbered each on its own; offsets come from the ranges' counts,
    one row a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__p", offset.alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.join(F.broadcast(counts), "__p").withColumn(name, F.col("__o") + rank).drop("__p", "__o")


def alias_roots(aliases: DataFrame) -> DataFrame:
    """Ultimate winner of every loser by pointer jumping: ``(loser_id, root_id)``.

    Each loser has one outgoing edge; a cycle would never settle and raises.
    """

    def jump(a: DataFrame) -> DataFrame:
        up = a.select(F.col("loser_id").alias("via"), F.col("root_id").alias("next"))
        return a.join(up, a["root_id"] == up["via"], "left").select("loser_id", F.coalesce("next", "root_id").alias("root_id"))

    start = aliases.where("loser_id <> winner_id").select("loser_id", F.col("winner_id").alias("root_id"))
    return iterate_until_stable(start, jump, _digest("loser_id", "root_id"), limit=64)


def rewrite_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between ultimate winners: distinct, without self-loops."""
    a, b = (roots.select(F.col("loser_id").alias(f"l{i}"), F.col("root_id").alias(f"r{i}")) for i in (1, 2))
    joined = edges.join(a, F.col("citing_id") == F.col("l1"), "left").join(b, F.col("cited_id") == F.col("l2"), "left")
    out = joined.select(F.coalesce("r1", "citing_id").alias("citing_id"), F.coalesce("r2", "cited_id").alias("cited_id"))
    return out.where("citing_id <> cited_id").distinct()


def rehome(rows: DataFrame, roots: DataFrame, key: list[str], order: list[str], column: str = "paper_id") -> DataFrame:
    """Sidecar rows moved to ultimate winners; the winner's own row, then the first by ``order``, stays."""
    moved = rows.join(roots, rows[column] == roots["loser_id"], "left")
    moved = moved.withColumn("__own", F.col("root_id").isNull().cast("int")).withColumn(column, F.coalesce("root_id", column)).drop("loser_id", "root_id")
    w = Window.partitionBy(column, *key).orderBy(F.desc("__own"), *order)
    return moved.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__own")


def compact(papers: DataFrame, edges: DataFrame, aliases: DataFrame, sidecars: dict[str, tuple[DataFrame, list[str], list[str]]] | None = None, dry_run: bool = False) -> dict:
    """Compaction: losers go, their edges and sidecar rows move to the ultimate winners.

    ``dry_run`` leaves everything as it is and only reports how many papers would go.
    """
    roots = alias_roots(aliases)
    gone = papers.join(roots, papers["id"] == roots["loser_id"], "left_semi")
    if dry_run:
        return {"papers": papers, "edges": edges, "deleted": gone.count()}
    out = {"papers": papers.join(roots, papers["id"] == roots["loser_id"], "left_anti"), "edges": rewrite_edges(edges, roots)}
    for name, (rows, key, order) in (sidecars or {}).items():
        out[name] = rehome(rows, roots, key, order)
    return out
