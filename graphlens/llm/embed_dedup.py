"""Operator 3: embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is rotated by seeded random orthogonal matrices. The
signs of the first rotation are its binary code x (a corner of the unit cube);
the stored correction factor is c = <x, o> for the rotated unit vector o. For a
rotated unit vector q, <x, q>/c estimates <o, q> without bias: the part of q
that is not along o has a length of sqrt(1-cos^2) and a random direction, so the
error is ``sqrt(1-c^2)/c * sqrt(1-cos^2)`` times one coordinate of a random unit
vector of d-1 dimensions. For a true cosine of ``threshold`` or more it is at
most ``sqrt(1-c^2)/c * sqrt(1-threshold^2) * z/sqrt(d-1)`` with confidence ``z``
(in d <= z^2 + 1 dimensions the coordinate's bound of 1 holds instead, always).
Pairs whose upper bound stays below the threshold are dropped, all others are
recomputed exactly in double precision, and only those decide.

Candidates: further signs of the rotations form ``T`` table keys of ``k`` bits;
k follows log2(n) so that a bucket keeps about ``bucket`` vectors, and T is the
least number of tables that misses a pair at exactly the threshold with a
probability of at most ``miss``. Pairs above it are missed far more rarely.

Edge cases: null, empty, zero, non-finite or null-holding vectors link with
nothing and are their own component (a vector whose copies all lack an id has none); vectors of different lengths do not link;
exact copies count as links of each other and are compared once; ties keep the
smallest id; empty tables give empty results; other columns are ignored.

What is shuffled per table is a vector as it came (single precision stays so),
its correction factor and its packed keys.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import components, cut, forest, join_by_key, split_hot, table


@functools.lru_cache(maxsize=4)
def rotations(d: int, columns: int, seed: int = 20) -> np.ndarray:
    """``d x columns`` directions, columns from as many random orthogonal matrices as needed."""
    rng = np.random.default_rng([seed, d])
    out = []
    while sum(m.shape[1] for m in out) < columns:
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.concatenate(out, axis=1)[:, :columns]


def plan_tables(n: int, threshold: float, bucket: int, miss: float) -> tuple[int, int]:
    """Bits a key and number of tables for ``n`` vectors."""
    k = max(2, round(math.log2(max(n, 1) / bucket))) if n else 2
    hit = (1 - math.acos(threshold) / math.pi) ** k
    return k, math.ceil(math.log(miss) / math.log1p(-hit))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(k: int, tables: int, kind: str):
    """mapInArrow body: raw numbers, correction factor and table keys of each vector."""
    small = np.min_scalar_type(-(1 << k))

    def run(batches):
        for b in batches:
            rows = b.column("embedding").to_pylist()
            for d in sorted({len(r) for r in rows}):
                at = [i for i, r in enumerate(rows) if len(r) == d]
                x = np.array([rows[i] for i in at], dtype=np.float64)
                z = _unit(x) @ rotations(d, max(d, tables * k))
                factor = np.abs(z[:, :d]).sum(1) / math.sqrt(d)
                bits = (z[:, : tables * k] > 0).reshape(len(at), tables, k)
                keys = (bits * (1 << np.arange(k, dtype=np.int64))).sum(2).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rep").take(pa.array(at)),
                        b.column("mult").take(pa.array(at)),
                        pa.array([d] * len(at), pa.int32()),
                        pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()),
                        pa.array(factor),
                        pa.array([r.tobytes() for r in keys.astype(small)], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int32())),
                    ],
                    names=["rep", "mult", "dim", "vec", "factor", "key_bytes", "keys"],
                )

    return run


def _compare(threshold: float, z: float, k: int, kind: str):
    """mapInArrow body over rows sorted by group: link counts and a spanning forest."""
    small = np.min_scalar_type(-(1 << k))

    def group(rows):
        d, t = rows["dim"][0], rows["t"][0]
        x = np.frombuffer(b"".join(rows["vec"]), dtype=kind).astype(np.float64).reshape(-1, d)
        o = _unit(x)
        keys = np.frombuffer(b"".join(rows["key_bytes"]), dtype=small).reshape(len(x), -1)
        mult, factor = np.array(rows["mult"]), np.array(rows["factor"])
        blk = np.array(rows["blk"])
        cross = rows["b1"][0] != rows["b2"][0]
        left = np.flatnonzero(blk == rows["b1"][0]) if cross else np.arange(len(x))
        right = np.flatnonzero(blk == rows["b2"][0]) if cross else left
        rot = (o @ rotations(d, d)).astype(np.float32)
        code = np.where(rot > 0, np.float32(1 / math.sqrt(d)), np.float32(-1 / math.sqrt(d)))
        spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor
        error = math.sqrt(max(0.0, 1 - threshold**2)) * min(1.0, z / math.sqrt(max(1, d - 1)))
        least = (threshold - spread * error - 1e-5) * factor
        links, ea, eb = np.zeros(len(x), dtype=np.int64), [], []
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        for s in range(0, len(left), 512):
            rows_at = left[s : s + 512]
            i, j = np.nonzero(code[rows_at] @ rot[right].T >= least[rows_at, None].astype(np.float32))
            i, j = rows_at[i], right[j]
            if not cross:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 16):
                a, b = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                cos = np.einsum("ij,ij->i", o[a], o[b])
                near = np.abs(cos - threshold) < 1e-9
                if near.any():  # at the threshold, the plain formula decides
                    cos[near] = np.einsum("ij,ij->i", x[a[near]], x[b[near]]) / (norm[a[near]] * norm[b[near]])
                ok = cos >= threshold
                a, b = a[ok], b[ok]
                if t:  # count a pair in the first table it shares
                    first = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
                    a, b = a[first], b[first]
                np.add.at(links, a, mult[b])
                np.add.at(links, b, mult[a])
                ea.append(a)
                eb.append(b)
            if sum(map(len, ea)) > 500_000:
                root = forest(np.concatenate(ea), np.concatenate(eb), len(x))
                ea, eb = [np.arange(len(x))], [root]
        if not ea:
            return None
        root = forest(np.concatenate(ea), np.concatenate(eb), len(x))
        rep, some = np.array(rows["rep"]), links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])

    def run(batches):
        names, held, at = None, None, None
        for b in batches:
            names = b.schema.names
            g = b.column("grp").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for s, e in zip(edges[:-1], edges[1:]):
                part = {c: b.column(c).slice(s, e - s).to_pylist() for c in names if c != "grp"}
                if held is not None and at == g[s]:
                    for c, v in part.items():
                        held[c].extend(v)
                else:
                    if held is not None and len(held["rep"]) > 1 and (got := group(held)) is not None:
                        yield got
                    held, at = part, g[s]
        if held is not None and len(held["rep"]) > 1 and (got := group(held)) is not None:
            yield got

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, bucket: int = 512, miss: float = 1e-3, z: float = 5.0, block: int = 1024) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of all rows of ``vectors(vec_id, embedding)``."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    whole = F.coalesce(F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = v.where(whole)
    reps = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).where("rep is not null"))
    n = reps.count()
    k, tables = plan_tables(n, threshold, bucket, miss)
    coded = reps.mapInArrow(_encode(k, tables, kind), "rep long, mult long, dim int, vec binary, factor double, key_bytes binary, keys array<int>")
    rows = coded.select("*", F.posexplode("keys").alias("t", "key")).drop("keys")
    dealt = split_hot(rows.withColumn("bucket", F.xxhash64("dim", "t", "key")).drop("key"), n * tables, block)
    grouped = dealt.withColumn("grp", F.xxhash64("bucket", "b1", "b2")).drop("bucket")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = grouped.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_compare(threshold, z, k, kind), "rep long, links long, root long")
    found = cut(found)
    comps = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("embedding", "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = join_by_key(valid, named, ["embedding"], "mult").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    alone = v.where(~whole).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all embeddings, links at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
