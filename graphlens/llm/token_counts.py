"""Operator 5: greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node has a failure link and the
number of tokens that following it pops, computed once in breadth-first order:
a token's node pops itself and falls to the root; any other node takes its
parent's pops and then walks failures until the byte fits. A word is then read
once, left to right, without backing up and without building a piece.

A word is a run of non-space characters with the one space before it. A byte
that no vocabulary piece can start counts as one unknown piece.

Edge cases: null or empty text has no words and no pieces; very long texts are
read word by word and very long words byte by byte; repeated rows are counted
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, table

_WORDS = re.compile(r" ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]")
#: Most words kept with their counts in a worker.
_MEMO = 300_000


class Automaton:
    """Trie with failure links and popped-token counts over a vocabulary of byte strings.

    All 256 single bytes are nodes of their own, so a walk never gets stuck; a
    byte that no piece covers counts as one.
    """

    def __init__(self, vocabulary):
        self.go: list[dict[int, int]] = [{}]
        is_token = [False]
        for piece in [*vocabulary, *(bytes([b]) for b in range(256))]:
            at = 0
            for byte in piece:
                nxt = self.go[at].get(byte)
                if nxt is None:
                    nxt = self.go[at][byte] = len(self.go)
                    self.go.append({})
                    is_token.append(False)
                at = nxt
            is_token[at] = at > 0 or is_token[at]
        n = len(self.go)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0]
        while level:
            below = []
            for u in level:
                for byte, v in self.go[u].items():
                    below.append(v)
                    if is_token[v]:
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, pops = self.fail[u], self.pops[u]
                    while byte not in self.go[z]:
                        pops += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = self.go[z][byte], pops
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of ``word``."""
        go, fail, pops = self.go, self.fail, self.pops
        at = total = 0
        for byte in word:
            while byte not in go[at]:
                total += pops[at]
                at = fail[at]
            at = go[at][byte]
        while at:
            total += pops[at]
            at = fail[at]
        return total


@functools.cache
def automaton(path: str) -> Automaton:
    """The automaton of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return Automaton(pieces)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_pieces, n_bytes, longest_word_pieces)`` of every whole text."""

    def run(batches):
        auto = automaton(path)

        class Memo(dict):
            def __missing__(self, word):
                if len(self) >= _MEMO:
                    self.clear()
                n = auto.count(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    self[word] = n
                return n

        memo = Memo()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                counts = list(map(memo.__getitem__, _WORDS.findall(t or "")))
                rows.append((len(counts), sum(counts), len((t or "").encode("utf-8", "replace")), max(counts, default=0)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_pieces", "n_bytes", "longest_word_pieces"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_bytes long, longest_word_pieces long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of all documents over the public byte vocabulary."""
    bounded_batches(spark)
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
