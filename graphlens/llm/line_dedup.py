"""Operator 9: line dedup by content-defined chunks of lines.

A text is cut at newlines. A rolling hash over the hashes of the last two lines
chooses chunk ends (one place in ``spacing``), so chunks depend on their own
lines only and reappear wherever those lines do, however far they are shifted.
Chunks of at least two lines are compared over all documents: 128-bit hashes
propose equal chunks, equal bytes confirm them, and all but the first (smallest
doc_id, then place) are removed with their newlines.

Chunks miss passages whose ends they don't share, and passages of one line, so
with ``passage_words`` every shortest run of lines that reaches that many words
is compared the same way: a line goes when it lies in a run of that many words
that occurs earlier.

Edge cases: null text stays null and empty text empty; a text whose chunks all
occur earlier becomes empty; repeated rows with one doc_id count as one
document for what comes first, so they keep the same chunks; rows with a null
doc_id are kept as they are; very long texts are handled a line at a time;
extra columns pass through whatever their names, but for one named like the
count. A chunk or passage that a third of all documents hold is dealt over many
tasks, in blocks of ``block`` occurrences.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, cut, join_by_key, pieces, table

_MIX = 0x9E3779B97F4A7C15


def chunks(text: str, spacing: int = 3) -> list[tuple[int, int]]:
    """``(first line, end line)`` of the chunks that tile a text's lines."""
    lines = text.split("\n")
    out, start, before = [], 0, 0
    for i, x in enumerate(lines):
        h = xxhash.xxh64_intdigest(x.encode("utf-8", "replace"))
        roll = ((before * _MIX + h) * _MIX) & (2**64 - 1)
        before = h
        if (roll >> 32) % spacing == 0 or i + 1 == len(lines):
            out.append((start, i + 1))
            start = i + 1
    return out


def passages(lines: list[str], words: int = 50) -> set[tuple[int, int]]:
    """``(first line, end line)`` of the shortest runs from, and up to, each line that hold ``words`` words.

    Runs begin and end on a line with a word. Any run of ``words`` words or
    more is the union of the shortest ones inside it, so a passage that occurs
    twice is found line by line, whatever surrounds it.
    """
    full, total = [], [0]
    for i, x in enumerate(lines):
        if n := len(x.split()):
            full.append(i)
            total.append(total[-1] + n)
    out, a = set(), 0
    for b in range(1, len(total)):
        if total[b] - total[a] >= words:
            while total[b] - total[a + 1] >= words:  # the shortest run from each of these lines ends here
                out.add((full[a], full[b - 1] + 1))
                a += 1
            out.add((full[a], full[b - 1] + 1))
    return out


def _spans(text: str | None, spacing: int, passage_words: int | None):
    """``(place, h1, h2)`` of the runs of lines that may be removed; a place holds first and end line."""
    if text is None:
        return
    lines = text.split("\n")
    found = {(s, e) for s, e in chunks(text, spacing) if e - s > 1 and any(x.strip() for x in lines[s:e])}
    if passage_words is not None:
        found |= passages(lines, passage_words)
    if found:
        digests = _digests(lines)
        for s, e in found:
            yield s << 32 | e, *_hash(digests, s, e)


def _lines(place: int) -> tuple[int, int]:
    return place >> 32, place & (2**32 - 1)


def _digests(lines: list[str]) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in lines)


def _hash(digests: bytes, s: int, e: int) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(digests[16 * s : 16 * e]))


def _cover(places) -> list[int]:
    """Some of ``places`` that hold the same lines, no line in more than two of them."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(map(_lines, places), key=lambda x: (x[0], -x[1])):
        if out and e <= out[-1][1]:
            continue
        while len(out) > 1 and out[-2][1] >= s:
            out.pop()
        out.append((s, e))
    return [s << 32 | e for s, e in out]


def remove_repeats(docs: DataFrame, spacing: int = 3, passage_words: int | None = None, count: str = "lines_removed", block: int = 4096) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text`` and the number of removed lines added as ``count``.

    ``passage_words`` also removes every passage of that many words that occurs
    earlier, wherever chunks end. A column of ``docs`` named ``count`` gives way.

    Hashes alone are shuffled to find repeats; texts move once, by doc_id, for
    both the byte comparison and the removal; bytes move only for runs that
    repeat, of a later occurrence no line more than twice.
    """

    def hashed(batches):
        for b in pieces(batches):
            rows = [
                (d, *span)
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for span in _spans(t, spacing, passage_words)
            ]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "place", "h1", "h2"])

    names = [c for c in docs.columns if c != count]
    own = {"__id", "__places", "__leading", "__gone"}
    inner = [f"{c} of the table" if c.lower() in own else c for c in names]
    base = docs.select(*(f"`{c}`" for c in names))
    if inner != names:
        base = base.toDF(*inner)
    if dict(docs.dtypes)["text"] != "string":  # no projection otherwise: it would keep the shuffles below from being one
        base = base.withColumn("text", F.col("text").cast("string"))
    known = base.where("doc_id is not null")  # both joins below read one shuffle of these rows
    found = cut(known.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, place long, h1 long, h2 long"))
    repeats = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("first")).where("n > 1"))
    seen = join_by_key(found, repeats, ["h1", "h2"], "n", "inner").withColumn("leads", F.struct("doc_id", "place") == F.col("first"))
    blocks = F.expr(f"cast(ceil(n / {float(block)}) as int)")
    asked = seen.groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_set(F.struct("place", blocks.alias("blocks"))).alias("__places"), F.collect_set(F.when(F.col("leads"), F.col("place"))).alias("__leading")
    )
    asked = cut(asked)

    def bodies(batches):
        for b in pieces(batches):
            rows = []
            for d, t, places, leading in zip(*(b.column(c).to_pylist() for c in ("__id", "text", "__places", "__leading"))):
                if t is None:
                    continue
                lines, leads, dealt = t.split("\n"), set(leading), {p["place"]: p["blocks"] for p in places}
                digests = _digests(lines)
                for p in [*leads, *_cover(set(dealt) - leads)]:
                    s, e = _lines(p)
                    rows.append((d, p, *_hash(digests, s, e), dealt[p], p in leads, "\n".join(lines[s:e]).encode("utf-8", "replace")))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "place", "h1", "h2", "blocks", "leads", "chunk"])

    held = known.join(asked, F.col("doc_id") == F.col("__id")).mapInArrow(bodies, "doc_id long, place long, h1 long, h2 long, blocks long, leads boolean, chunk binary")
    one = F.lit(0).cast("long")
    lead = held.where("leads").withColumn("blk", F.explode(F.sequence(one, F.col("blocks") - 1)))
    lead = lead.groupBy("h1", "h2", "blk").agg(F.min(F.struct("doc_id", "place", "chunk")).alias("lead"))
    rest = held.where("not leads").withColumn("blk", F.pmod(F.xxhash64("doc_id", "place"), F.col("blocks")))
    same = rest.join(lead, ["h1", "h2", "blk"]).where(F.col("chunk") == F.col("lead.chunk"))
    gone = same.groupBy("doc_id").agg(F.collect_set("place").alias("__gone"))

    def rewrite(batches):
        for b in pieces(batches):
            texts, counts = [], []
            for t, drop in zip(b.column("text").to_pylist(), b.column("__gone").to_pylist()):
                counts.append(0)
                if t is not None and drop:
                    lines = t.split("\n")
                    kept = [True] * len(lines)
                    for s, e in map(_lines, drop):
                        kept[s:e] = [False] * len(kept[s:e])
                    counts[-1] = len(lines) - sum(kept)
                    t = "\n".join(x for x, k in zip(lines, kept) if k)
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in inner]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*names, count])

    gone = gone.withColumnRenamed("doc_id", "__id")
    joined = known.join(gone, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    joined = joined.unionAll(base.where("doc_id is null").withColumn("__gone", F.lit(None).cast("array<long>")))
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, base.schema))
    return joined.mapInArrow(rewrite, f"{schema}, `{count}` long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated multi-line chunks and passages: doc_id, text, lines_removed."""
    bounded_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=50)
