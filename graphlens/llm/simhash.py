"""Operator 7: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: bit b is set when over half of the shingle hashes (XXH64, seed 42)
have it. Candidates: a covering code. Every bit i of a part gets a non-zero
vector phi(i) of r+1 bits; for each non-zero v the mask of v holds the bits
with <phi(i), v> odd. At most r differing bits span at most r dimensions, so
some v is orthogonal to all of them: the pair agrees under that mask, and a
pair within the radius *always* shares a table. With several parts one part
holds at most r of parts*(r+1)-1 differing bits, so the guarantee extends to
that radius.

``near_components`` links by the bits alone. ``similar_components`` takes such
links as proposals and confirms them on the texts' whole shingle sets.

Edge cases: null or blank text has fingerprint zero and an empty shingle set and
links like any other; fewer words than a shingle give one shingle; empty tables
give empty results; repeated rows share a fingerprint; null doc_id rows take
part, may tie others together, and never name a component (a component of such
rows alone has none); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, components, cut, drop_shuffles, few_components, forest, join_by_key, pieces, salted_join, split_hot, table

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles handled at a time; bounds memory on very long texts.
_SLICE = 1 << 15


def shingle_hashes(text: str | None, shingle: int, distinct: bool = False) -> np.ndarray:
    """Hash of every shingle, in order, or of every distinct one, sorted."""
    tokens = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    n, parts = max(1, len(tokens) - shingle + 1), []
    for s in range(0, n, _SLICE):
        part = tokens[s : s + _SLICE + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle))) if len(tokens) >= shingle else [tokens]
        parts.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs), dtype=np.uint64))
    h = np.concatenate(parts)
    return np.unique(h) if distinct else h


def bits_of(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit fingerprint words of shingle hashes; the first is plain SimHash.

    Further words use the same hashes after a fixed 64-bit mix, so they are
    independent bits at no extra hashing cost.
    """
    ones = np.zeros((words, 64), dtype=np.int64)
    for s in range(0, len(hashes), _SLICE):
        h = hashes[s : s + _SLICE]
        for w in range(words):
            if w:
                x = h + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1))
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
            else:
                x = h
            ones[w] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return [int(v) for v in np.packbits(ones * 2 > len(hashes), axis=1).view(np.int64)[:, 0]]


def fingerprint(text: str | None, shingle: int = 3, words: int = 1, distinct: bool = False) -> list[int]:
    """Fingerprint words of a text; ``distinct`` counts every shingle once, as a set similarity does."""
    return bits_of(shingle_hashes(text, shingle, distinct), words)


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell shingle sets apart, as two signed words."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype="<i8")
    return int(a), int(b)


def fingerprints(docs: DataFrame, shingle: int, words: int, distinct: bool = False) -> DataFrame:
    """``(doc_id, text_hash, w0, w1, ...)`` of every document's whole text; with ``distinct`` also the set's key ``(s0, s1)`` and size."""
    names = [f"w{w}" for w in range(words)] + (["s0", "s1", "size"] if distinct else [])

    def run(batches):
        for b in pieces(batches):
            got = []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, shingle, distinct)
                got.append((*bits_of(h, words), *((*_set_key(h), len(h)) if distinct else ())))
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "text_hash", *names])

    schema = ", ".join(f"{c} long" for c in ["doc_id", "text_hash", *names])
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)


def covering_masks(radius: int, parts: int = 1, words: int = 1) -> list[list[int]]:
    """Masks, each with a signed 64-bit word for every fingerprint word, over ``parts`` equal runs of bits.

    Any two fingerprints within ``parts * (radius + 1) - 1`` bits agree under one
    mask (bits left over by the division are in no part). A part's bits get the
    non-zero vectors of radius + 1 bits in turn, a simplex code, so every mask
    keeps about half of the part's bits.
    """
    width, out = 64 * words // parts, []
    phi = [1 + i % ((2 << radius) - 1) for i in range(width)]
    for p in range(parts):
        for v in range(1, 2 << radius):
            mask = sum(1 << (p * width + i) for i in range(width) if (phi[i] & v).bit_count() & 1)
            split = [mask >> (64 * w) & (2**64 - 1) for w in range(words)]
            out.append([m - (1 << 64) if m >> 63 else m for m in split])
    return out


def lightest_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Places of the links ``a[i] - b[i]`` that form a minimum spanning forest of ``n`` nodes."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    label, open_, chosen = np.arange(n), np.arange(len(a)), [np.zeros(0, dtype=np.int64)]
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return order[np.concatenate(chosen)]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[open_]], open_)
        np.minimum.at(best, label[b[open_]], open_)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        label = forest(label[a[pick]], label[b[pick]], n)[label]


#: Fingerprint bits of a step of the thresholds at which links are known to be needless.
_STEP_BITS = 4


def _links(words: int, within: int, least: float | None):
    """mapInArrow body over rows sorted by group and size: a spanning forest of each group's links.

    Plain links lead to the smallest node of a component in the group, so the
    groups of all tables agree on few centres and most links fall together.
    With ``least`` they are those with the fewest differing bits, and rows whose
    sizes alone rule that similarity out are not compared.

    A link between rows that links of no more bits tie already is left out at
    once, and a group whose rows are all tied (with ``least``: by links of at
    most half of ``within``) is not searched further, so that a group of copies
    costs a few comparisons a row.
    """
    levels = within // _STEP_BITS + 1

    def solve(group, meta, node, *w):
        n = len(node)
        cross, side, size = (meta & 2) > 0, meta & 1, meta >> 2
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, int)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        at, lag, held, look = np.arange(n), 1, 0, 8
        a, b, d = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.int16)]
        tied = None

        def shrink():  # links as a forest, not as pairs; what ties whom at each threshold; groups to search on
            x, y, z = np.concatenate(a), np.concatenate(b), np.concatenate(d)
            if least is not None:
                keep = lightest_forest(x, y, z, n)
                x, y, z = x[keep], y[keep], z[keep]
                now = np.stack([forest(x[z <= t], y[z <= t], n) for t in range(0, within + 1, _STEP_BITS)])
                whole = now[within // 2 // _STEP_BITS]
            else:
                whole = forest(x, y, n)
                x = np.flatnonzero(whole != np.arange(n))
                y, z = whole[x], np.zeros(len(x), np.int16)
                now = np.broadcast_to(whole, (levels, n))
            open_ = np.minimum.reduceat(whole, starts) != np.maximum.reduceat(whole, starts)
            return [x], [y], [z], now, open_

        while True:
            at = at[at + lag < n]
            near = run[at] == run[at + lag]
            if least is not None:
                near &= size[at + lag] * least <= size[at] + 1e-9
            at = at[near]
            if not len(at):
                break
            bits = sum(np.bitwise_count((x[at] ^ x[at + lag]).view(np.uint64)).astype(np.int16) for x in w)
            hit = (bits <= within) & (~cross[at] | (side[at] != side[at + lag]))
            ok, bits = at[hit], bits[hit]
            if tied is not None and len(ok):
                new = tied[bits // _STEP_BITS, ok] != tied[bits // _STEP_BITS, ok + lag]
                ok, bits = ok[new], bits[new]
            a.append(ok)
            b.append(ok + lag)
            d.append(bits)
            held += len(ok)
            if held > 500_000 or lag == look:
                a, b, d, tied, open_ = shrink()
                at, held, look = at[open_[run[at]]], 0, look * 4 if lag == look else look
            lag += 1
        a, b, d, *_ = shrink() if n else (a, b, d)
        return pa.RecordBatch.from_arrays([pa.array(node[a[0]]), pa.array(node[b[0]]), pa.array(d[0].astype(np.int64))], names=["src", "dst", "bits"])

    def run(batches):
        held = None
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) < 100_000:
                continue
            last = int(np.flatnonzero(np.append(True, held[0] != held[0][-1]))[-1])
            if last:
                yield solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    return run


def _proposals(nodes: DataFrame, words: int, parts: int, radius: int, within: int, block: int, least: float | None = None) -> DataFrame:
    """``(src, dst, bits)``: links of ``nodes(node, size, w0, ...)`` that share a table and differ in at most ``within`` bits."""
    w = [f"w{i}" for i in range(words)]
    masks = covering_masks(radius, parts, words)
    sides = [F.array(*(F.lit(m[i]) for m in masks)) for i in range(words)]
    key = lambda t: F.xxhash64(t, *(F.col(c).bitwiseAND(F.get(s, t)) for c, s in zip(w, sides)))
    keys = F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), key)
    dealt = split_hot(nodes.select(F.explode(keys).alias("bucket"), F.col("node").alias("rep"), "size", *w), nodes.count() * len(masks), block)
    flags = F.when(F.col("b1") != F.col("b2"), 2).otherwise(0) + (F.col("blk") == F.col("b2")).cast("int")
    grouped = dealt.select(F.xxhash64("bucket", "b1", "b2").alias("grp"), (F.col("size").cast("long") * 4 + flags).alias("meta"), "rep", *w)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(n, "grp").sortWithinPartitions("grp", "meta", "rep").mapInArrow(_links(words, within, least), "src long, dst long, bits long")


def _named(prints: DataFrame, nodes: DataFrame, key: list[str], tied: DataFrame) -> DataFrame:
    """``prints`` with the ``component`` of its node, by ``tied(node, component)``, and ``component_id``, the smallest id among its rows."""
    found = cut(tied.join(nodes.select("node", "rep", "rows"), "node").select("node", "component", "rep"))
    names = cut(found.groupBy("component").agg(F.min("rep").alias("name"), F.count("*").alias("n")))
    member = join_by_key(found.select("node", "component"), names, ["component"], "n").select("node", "component", "name")
    named = nodes.join(member, "node", "left").select(*key, "rows", F.coalesce("component", "node").alias("component"), F.coalesce("name", "rep").alias("component_id"))
    return join_by_key(prints, cut(named), key, "rows").drop("rows")


def _nodes(prints: DataFrame, key: list[str], more: list[str]) -> DataFrame:
    """One numbered row for each value of ``key``, with the smallest id and the number of its rows."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = prints.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), *(F.min(c).alias(c) for c in more))
    return cut(one.repartition(n, *key).withColumn("node", F.monotonically_increasing_id()))


def near_components(
    docs: DataFrame, shingle: int = 3, words: int = 1, parts: int = 1, radius: int = 3, within: int = 3, block: int = 16_384, distinct: bool = False
) -> DataFrame:
    """``(doc_id, w0..., component_id)``: groups of documents tied by fingerprints within ``within`` bits.

    ``within`` may not exceed what the tables cover, ``parts*(radius+1)-1`` bits,
    so no link is missed.

    Scale: equal fingerprints collapse by a partial aggregation; what is
    shuffled per table is a few longs; hot buckets are dealt as block pairs of
    ``block`` rows; groups return a spanning forest, never their pairs.
    """
    if within > parts * (radius + 1) - 1:
        raise ValueError("links reach beyond what the tables cover")
    w = [f"w{i}" for i in range(words)]
    prints = cut(fingerprints(docs, shingle, words, distinct).select("doc_id", *w))
    nodes = _nodes(prints, w, [])
    links = _proposals(nodes.withColumn("size", F.lit(0)), words, parts, radius, within, block)
    return _named(prints, nodes, w, components(links)).select("doc_id", *w, "component_id")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, set)``: sorted distinct shingle hashes of ``nodes(node, rep, s0, s1)`` from the rows of that id."""

    def run(batches):
        for b in pieces(batches):
            seen, sets = [], []
            for node, t, s0, s1 in zip(*(b.column(c).to_pylist() for c in ("node", "text", "s0", "s1"))):
                h = shingle_hashes(t, shingle, True)
                if _set_key(h) == (s0, s1):  # another row of that id may hold another text
                    seen.append(node)
                    sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = texts.join(nodes.select("node", "rep", "s0", "s1"), "rep").select("node", "text", "s0", "s1")
    return found.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """``(src, dst, ok)``: whether the shingle sets of each pair are similar enough."""

    def run(batches):
        for b in pieces(batches):
            ok, last, right = [], None, None
            for src, x, y in zip(b.column("src").to_pylist(), b.column("other").to_pylist(), b.column("set").to_pylist()):
                if src != last:
                    last, right = src, np.frombuffer(x, dtype=np.uint64)
                left = np.frombuffer(y, dtype=np.uint64)
                both = len(left) + len(right)
                shared = both - len(np.unique(np.concatenate([left, right])))
                ok.append(shared * (1 + least) >= least * both - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(ok, pa.bool_())], names=["src", "dst", "ok"])

    one = salted_join(pairs, sets.select(F.col("node").alias("dst"), "set"), "dst", block)
    two = salted_join(one, sets.select(F.col("node").alias("src"), F.col("set").alias("other")), "src", block, pairs)
    return two.select("src", "dst", "set", "other").mapInArrow(run, "src long, dst long, ok boolean")


def _recheck(proposed: DataFrame, checked: DataFrame, nodes: DataFrame, sets: DataFrame, least: float, within: int, block: int) -> DataFrame:
    """``(src, dst)``: links between similar enough nodes that the proposals left out because refused links seemed to tie them.

    ``proposed`` holds forests, so a pair left out has both ends in one of their
    components; where every link of it was confirmed the pair is tied for
    certain. In the others all pairs within ``within`` bits that confirmed links
    don't tie are compared. A component is dealt by a hash into blocks of about
    ``block`` nodes (and half a million shingles), and every pair of blocks is a
    group with its nodes' sets, so that sets move once a block, not once a pair.
    """
    part = cut(few_components(proposed))
    refused = checked.where("not ok").join(part.select(F.col("node").alias("src"), "component"), "src").select("component").distinct()
    tied = few_components(checked.where("ok")).select("node", F.col("component").alias("label"))
    w = [c for c in nodes.columns if c[0] == "w" and c[1:].isdigit()]
    open_ = cut(part.join(refused, "component", "left_semi").join(tied, "node", "left").join(nodes.select("node", "size", *w), "node"))
    many = open_.groupBy("component").agg(F.expr(f"cast(ceil(greatest(count(*) / {float(block)}, sum(size) / {float(1 << 19)})) as int)").alias("nb"))
    dealt = open_.join(many, "component").join(sets, "node").withColumn("label", F.coalesce("label", "node"))
    dealt = dealt.withColumn("blk", F.expr("cast(pmod(xxhash64(node, 7), nb) as int)")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = dealt.select("component", F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "node", "label", "size", "set", *w)

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        blk, b1, b2, node, label, size = (t.column(c).to_numpy() for c in ("blk", "b1", "b2", "node", "label", "size"))
        words, own = [t.column(c).to_numpy() for c in w], [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").to_pylist()]
        label, cross, place, links = label.copy(), len(b1) and b1[0] != b2[0], np.arange(len(node)), []
        for i in range(len(node)):
            at = (place > i) & (label != label[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9)
            if cross:
                at &= blk != blk[i]
            at = np.flatnonzero(at)
            bits = sum(np.bitwise_count((x[at] ^ x[i]).view(np.uint64)).astype(np.int16) for x in words)
            at = at[bits <= within]
            if not len(at):
                continue
            theirs, ends = np.concatenate([own[j] for j in at]), np.append(0, np.cumsum([len(own[j]) for j in at]))
            found = np.searchsorted(own[i], theirs)
            hit = np.zeros(len(theirs) + 1, np.int64)
            if len(own[i]):
                hit[1:] = np.cumsum(own[i][np.minimum(found, len(own[i]) - 1)] == theirs)
            shared, both = hit[ends[1:]] - hit[ends[:-1]], np.diff(ends) + len(own[i])
            for j in at[shared * (1 + least) >= least * both - 1e-9]:
                if label[j] != label[i]:
                    links.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"src": pa.array([int(x[0]) for x in links], pa.int64()), "dst": pa.array([int(x[1]) for x in links], pa.int64())})

    return dealt.groupBy("component", "b1", "b2").applyInArrow(solve, "src long, dst long")


def similar_components(
    docs: DataFrame, least: float = 0.8, shingle: int = 5, words: int = 2, parts: int = 5, radius: int = 4, within: int = 29, block: int = 16_384
) -> DataFrame:
    """``(doc_id, text_hash, component, component_id)``: groups tied by a shingle-set similarity of ``least`` or more.

    ``component`` tells groups apart, ``component_id`` is a group's smallest id.

    Proposals are the pairs that share a table and differ in at most ``within``
    fingerprint bits. For shingle similarity 0.8 the 128 bits of two
    distinct-shingle fingerprints differ in 19.4 places on average, with a
    deviation of 4. All pairs within ``parts*(radius+1)-1`` = 24 bits share a
    table; of those at 25 to 29 bits about one in a hundred doesn't, as a part's
    bits seldom span all its dimensions. Of each table's groups the links of a
    spanning forest with the fewest differing bits are proposed, and a link
    counts only if the two whole shingle sets are similar enough. Where a link is
    refused, what it stood for is compared pair by pair (``_recheck``), so a
    group is tied as by all pairs of its tables. Rows without an id are left out.

    Proposals number at most a document and table; those of a group of copies
    are mostly the same in every table, as its rows come in the same order.
    """
    docs = docs.where("doc_id is not null")
    w, key = [f"w{i}" for i in range(words)], ["s0", "s1"]
    prints = cut(fingerprints(docs, shingle, words, True))
    nodes = _nodes(prints, key, ["size", *w])
    found = _proposals(nodes, words, parts, radius, within, block, least).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    proposed = cut(found.distinct())
    drop_shuffles(docs.sparkSession)
    asked = proposed.select(F.col("src").alias("node")).union(proposed.select("dst")).distinct()
    sets = cut(_shingle_sets(docs, nodes.join(asked, "node", "left_semi"), shingle))
    checked = cut(_confirm(proposed, sets, least, min(block, 4096)))
    drop_shuffles(docs.sparkSession)
    links = cut(checked.where("ok").select("src", "dst").unionAll(_recheck(proposed, checked, nodes, sets, least, within, min(block, 512))))
    got = _named(prints.select("doc_id", "text_hash", *key), nodes.select("node", "rep", "rows", *key), key, few_components(links))
    return got.select("doc_id", "text_hash", "component", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: 3-word shingles, 64-bit fingerprints, links at 3 or fewer bits."""
    bounded_batches(spark)
    got = near_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")
