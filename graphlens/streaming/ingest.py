"""Structured Streaming: staged records in micro-batches, late edges, windows over events.

The state of the corpus is a versioned Parquet folder. Every micro-batch writes
the next version under its batch id, so a repeated batch overwrites its own
version and changes nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from graphlens.operators.components import connected_components, number_rows
from graphlens.operators.graph import promote
from graphlens.operators.match import KEYS, identity_edges
from graphlens.operators.resolve import apply_merges, merge_plan


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """Staged JSON records; ``files`` a trigger bounds a batch, which is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def edges_in_batches(stream: DataFrame, papers: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Pending edges stream in; resolved ones are promoted, the others wait in the state for later papers.

    Version ``n`` of ``edges`` and ``pending`` is written by batch ``n`` from
    version ``n - 1``.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        waiting = spark.read.parquet(f"{state}/pending/v{n - 1}").unionByName(batch) if n else batch
        done, left = promote(waiting, papers)
        known = spark.read.parquet(f"{state}/edges/v{n - 1}") if n else done.limit(0)
        known.unionByName(done).distinct().write.mode("overwrite").parquet(f"{state}/edges/v{n}")
        left.write.mode("overwrite").parquet(f"{state}/pending/v{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(old: DataFrame | None, batch: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Papers after a batch of records, and the aliases it made.

    Records and papers that share an identifier, in any chain and in either
    input, become one paper; tombstoned papers take no part. New papers get the
    ids after the largest, in order of their identifiers.
    """
    cols = [*KEYS, *fields]
    new = number_rows(batch.select(*cols), cols, "__n")
    if old is None:
        new = new.withColumn("id", F.col("__n") + 1)
    else:
        top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        new = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("__n") + 1)  # top is one row
    new = new.select("id", *cols, F.lit(0).alias("tombstone"))
    rows = new if old is None else old.unionByName(new)
    found = connected_components(identity_edges(rows.where("tombstone = 0"), record_id="id"))
    members = rows.join(found.withColumnRenamed("node", "id"), "id")
    return apply_merges(rows, merge_plan(members.select("component", "id", *cols), fields), fields)


def papers_in_batches(stream: DataFrame, fields: tuple[str, ...], state: str, checkpoint: str) -> StreamingQuery:
    """Staged records stream in; every batch writes the next version of ``papers`` and ``aliases``."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{state}/papers/v{n - 1}") if n else None
        papers, aliases = merge_batch(old, batch, fields)
        papers.write.mode("overwrite").parquet(f"{state}/papers/v{n}")
        if n:
            aliases = aliases.unionByName(spark.read.parquet(f"{state}/aliases/v{n - 1}"))
        aliases.distinct().write.mode("overwrite").parquet(f"{state}/aliases/v{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, state: str, name: str, n: int) -> DataFrame:
    """State table ``name`` after batch ``n``."""
    return spark.read.parquet(f"{state}/{name}/v{n}")


def dirty(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose row is new or changed: the feed of incremental work."""
    cols = [c for c in current.columns if c != key]
    digest = lambda d, name: d.select(key, F.xxhash64(*cols).alias(name))
    j = digest(current, "now").join(digest(previous, "then"), key, "left")
    return j.where("then is null or now <> then").select(key)


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Count and sum of values by window and type. Beyond the reference: it has no event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Progress(StreamingQueryListener):
    """Counters of running streams: rows and batches by query, in the order they report."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """A stream began."""
        self.rows.setdefault(str(event.id), 0)
        self.batches.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        """A batch ended."""
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """Nothing to count."""
