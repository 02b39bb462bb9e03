"""Operator 8: cost-balanced packing of tokenised documents into fixed-length sequences.

Each task packs its own input partition in shards of about ``shard`` tokens, so
there is no shuffle and no group that grows with the corpus. In a shard the
documents, cut into pieces of at most ``capacity`` tokens, are taken in
descending length; each goes to the lowest-cost sequence that has room for all
of it (cost of a piece of n tokens: n + n^2 * quadratic), or, where none has,
is cut to fill the lowest-cost sequence with any room left. A shard has exactly as many
sequences as its tokens fill; what is left over goes to the next shard, and at
the end of the partition into sequences of power-of-two lengths, which need no
padding. So no sequence is padded at all.

Token ids: byte-level BPE of the public vocabulary, as a default ``tokenizers``
call without added tokens gives them: the string of a special token is that
token. The ``.tiktoken`` twin holds the same vocabulary and gives the same ids
several times faster, so it does the encoding; long texts without white space,
on which it is slow, go through the ``tokenizers`` file. Tests hold both equal,
on every code point and on either side of that length.

Edge cases: null or empty text is one piece of the end id alone; a very long
text is encoded in slices cut between a non-space and a white-space character,
where no token can span; repeated rows are packed like any other; an empty
table gives an empty result; other columns are ignored. sequence_id holds the
partition above 32 bits; it is stable for a stable input partitioning (a scan).
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, table

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"
#: Longest slice of a text given to the encoder at once.
_SLICE = 100_000


@functools.cache
def encoder(json_path: str, ranks_path: str):
    """Text to a list of ids; the twin vocabulary, or the tokenizer file for a long run without white space."""
    import public_tokenizers
    import tiktoken

    with open(json_path, "rb") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks_path, "rb") as f:
        ranks = {k: i for k, i in ((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)) if i not in special.values()}
    fast = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cache
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        if len(text) <= 4 * _SLICE:
            return fast.encode(text, allowed_special="all") if any(x in text for x in special) else fast.encode_ordinary(text)
        return exact().encode(text, add_special_tokens=False).ids

    return encode


def slices(text: str, size: int = _SLICE):
    """Cut ``text`` before white space that follows a non-space, at ``size`` characters or later."""
    s = 0
    while len(text) - s > size:
        e = s + size
        while e < len(text) and not (text[e] in " \n" and not text[e - 1].isspace()):
            e += 1
        yield text[s:e]
        s = e
    yield text[s:]


def token_ids(text: str | None, encode, end_id: int) -> np.ndarray:
    """All ids of a text and the end id."""
    parts = [np.array(encode(p), dtype="<u4") for p in slices(text or "") if p]
    return np.concatenate([*parts, np.array([end_id], dtype="<u4")])


def power_parts(n: int) -> list[int]:
    """Powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_shard(pieces: list[tuple], rooms: list[int], quadratic: float) -> tuple[list[list], list[tuple]]:
    """Pieces ``(key, start, length)`` of each sequence with ``rooms`` capacities; what didn't fit."""
    room, cost = np.array(rooms, dtype=np.int64), np.zeros(len(rooms))
    out, over = [[] for _ in rooms], []
    for key, start, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            if not fits.any():
                over.append((key, start, n))
                break
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(n, int(room[at]))
            out[at].append((key, start, take))
            room[at] -= take
            cost[at] += take + take * take * quadratic
            start, n = start + take, n - take
    return out, over


def _pack(json_path: str, ranks_path: str, end_id: int, capacity: int, shard: int, quadratic: float):
    def run(batches):
        encode = encoder(json_path, ranks_path)
        base, made = TaskContext.get().partitionId() << 32, 0
        docs, pieces, held, serial = {}, [], 0, 0

        def flush(last: bool):
            nonlocal pieces, held, docs, made
            rest = held % capacity
            rooms = [capacity] * (held // capacity) + (power_parts(rest) if last else [])
            got, over = pack_shard(pieces, rooms, quadratic)
            rows = []
            for seq in got:
                offset = 0
                for key, start, n in seq:
                    doc_id, ids = docs[key]
                    rows.append((doc_id, start, n, len(ids), base + made, offset, ids[start : start + n].tobytes()))
                    offset += n
                made += 1
            pieces, held = over, sum(p[2] for p in over)
            docs = {p[0]: docs[p[0]] for p in over}
            for s in range(0, len(rows), 2000):
                cols = list(zip(*rows[s : s + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids"],
                )

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(text.as_py(), encode, end_id)
                docs[serial] = (doc_id, ids)
                pieces.extend((serial, s, min(capacity, len(ids) - s)) for s in range(0, len(ids), capacity))
                held += len(ids)
                serial += 1
                if held >= shard:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 1, capacity: int = 2048, shard: int = 1 << 19, quadratic: float = 1 / 4096) -> DataFrame:
    """Pieces of all documents: where each lies, and its token ids as little-endian 32-bit integers."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(_pack(json_path, ranks_path, end_id, capacity, shard, quadratic), SCHEMA)


def public_paths() -> tuple[str, str]:
    """The vocabulary file and its twin."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(packed: DataFrame) -> DataFrame:
    """Contract columns of packed pieces."""
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return digest(pack(table(spark, sf_dir, "documents"), *public_paths()))
