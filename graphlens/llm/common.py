"""Shared plumbing of the training-data operators: reading, slices, hot buckets, forests."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.components import connected_components as components
from graphlens.operators.components import cut, shared_folder

__all__ = ["bounded_batches", "components", "cut", "drop_shuffles", "few_components", "forest", "give_back", "join_by_key", "pieces", "salted_join", "shared_folder", "small_side", "split_hot", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Spark send batches of at most ``size`` bytes to Python, a row at least, where it would send more.

    Texts are large, and how many rows they are says little. The setting is the
    session's, as Spark reads it when a query runs; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Return free memory of a worker to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files behind finished checkpoints go; Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batches, rows: int = 1000):
    """Arrow batches in slices of ``rows``; free memory goes back at the end.

    Python objects exist for one slice at a time, whatever Spark's batch size.
    """
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)
    give_back()


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows, else as it is.

    ``df`` must be cheap to count (a checkpoint); beyond the bound Spark shuffles it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``facts``, which has one row a key and in ``weight`` the number of rows of that key.

    Keys with more rows than an even share of a task are joined by broadcast:
    they are fewer than there are shuffle partitions. The others are shuffled.
    ``facts`` must be cheap to read again (a checkpoint).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (facts.agg(F.sum(weight)).first()[0] or 0) // n)
    hot = facts.where(F.col(weight) > share)
    if not hot.limit(1).count():
        return rows.join(facts, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(weight) <= share), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, block: int, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, one wide row a key, with no key's rows in one task.

    Keys with more than ``block`` rows are dealt over as many tasks as they have
    blocks, and their wide row is repeated there. ``counted`` holds the same
    keys as ``rows`` and is cheaper to count.
    """
    many = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    many = cut(many.select(key, F.expr(f"cast(ceil(__n / {float(block)}) as int)").alias("__parts")))
    parts, others = F.coalesce("__parts", F.lit(1)).cast("long"), [c for c in rows.columns if c != key and dict(rows.dtypes)[c] != "binary"]
    dealt = rows.join(small_side(many, 100_000), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), parts) if others else F.lit(0).cast("long")).drop("__parts")
    wide = facts.join(small_side(many, 100_000), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return dealt.join(wide, [key, "__salt"]).drop("__salt")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        for x in (label[a], label[b]):  # roots only: a lower label for others would cut them off from theirs
            np.minimum.at(label, x, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def few_components(links: DataFrame, few: int = 1 << 20) -> DataFrame:
    """``components(links)``, in one task for at most ``few`` links ``(src, dst)`` of long ids.

    Every round of ``components`` shuffles the links several times. Where they
    are few, its tasks, with their files and their records, take far more disk
    than the links; beyond ``few`` the rounds are made. ``links`` must be cheap
    to read again (a checkpoint).
    """
    if links.count() > few:
        return components(links)

    def solve(batches):
        ends = [np.zeros((2, 0), np.int64), *(np.stack([b.column(i).to_numpy() for i in range(2)]) for b in batches)]
        ids, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        found = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest(a, b, len(ids))])], names=["node", "component"])
        for s in range(0, found.num_rows, 1 << 16):
            yield found.slice(s, 1 << 16)
        give_back()

    return links.select("src", "dst").where("src <> dst").coalesce(1).mapInArrow(solve, "node long, component long")


def split_hot(rows: DataFrame, n: int, block: int) -> DataFrame:
    """Deal ``n`` ``rows(bucket, rep, ...)`` into block pairs so that no task gets a hot bucket.

    Rows are counted by slots of their bucket's hash, about ``block / 8`` rows a
    slot, so the counts stay far smaller than the rows; only rows in a slot of
    more than ``block`` rows are dealt: cut into blocks by a hash of ``rep``,
    with every pair of blocks a group, so each pair of rows of a bucket meets in
    exactly one group (two rows of one block meet in the group b1 = b2). The
    slots over the limit number at most ``n / block``.
    """
    slots = 1 << max(0, (8 * n // block).bit_length())
    slotted = rows.withColumn("slot", F.pmod("bucket", F.lit(slots)))
    hot = cut(slotted.groupBy("slot").agg(F.count("*").alias("slot_size")).where(F.col("slot_size") > block))
    dealt = slotted.join(small_side(hot, 100_000), "slot", "left")
    dealt = dealt.withColumn("nb", F.expr(f"cast(ceil(coalesce(slot_size, 1) / {float(block)}) as int)"))
    dealt = dealt.withColumn("blk", F.expr("cast(pmod(xxhash64(rep, 7), nb) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    return dealt.select("*", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2")).drop("slot", "slot_size", "nb", "other")
