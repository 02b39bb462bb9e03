"""Operator 10: SentencePiece-style encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of the whole normalised text (a space mark
first, spaces as marks) with the highest sum of piece scores; on equal sums the
last piece is the longest, then the one before it, and so on. A character that
is no piece costs less than any piece and is written as its UTF-8 byte pieces.

A giant text is cut into chunks. The boundary state between two chunks is how
many characters the piece across the cut reaches into the next chunk. Each
chunk yields a matrix: best score from entry state to exit state. Max-plus
products of these are associative, so a parallel prefix scan gives every chunk
its entry scores; each chunk then finds, alone, which entry every exit traces
back to; composing these small maps from the right fixes the exits, and the
chunks trace their pieces independently.

Where no piece holds a space mark after another character (checked on the
vocabulary), every path passes the places before marks, so a chunk's matrix
needs only its first and last words per state and words are memoised.

Edge cases: null or empty text has no pieces; decoding null gives null; very
long words without a space run the plain recurrence; texts that hold the space
mark itself decode to spaces there; repeated rows are encoded alike; rows are
told apart by position, not id, so equal or null ids are no trouble; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, cut, table

MARK = "▁"
_MEMO = 160_000
_LOST = -np.inf


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file; nothing is trained."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: dict[int, int]):
        self.rank = {p: (s, i) for p, i, s in pieces}
        self.longest = max((len(p) for p in self.rank), default=1)
        self.byte_ids = byte_ids
        self.missing = min((s for s, _ in self.rank.values()), default=0.0) - 10.0
        self.safe = all(MARK not in p.lstrip(MARK) for p in self.rank)
        #: Characters in no piece: every path passes the places before and after them.
        self.lone = "".join(c for c in "\n\t" if all(c not in p for p in self.rank))
        self.text = {i: p for p, (_, i) in self.rank.items()}
        self.byte = {i: b for b, i in byte_ids.items()}
        #: Trie of the pieces: a node is [score, id, nodes by next character], score null inside a piece.
        self.root: dict[str, list] = {}
        for p, (score, i) in self.rank.items():
            nodes = self.root
            for ch in p:
                node = nodes.setdefault(ch, [None, -1, {}])
                nodes = node[2]
            node[0], node[1] = score, i

    def forward(self, s: str, entry: dict[int, float], end: int, stop: int) -> tuple[list[float], list[int]]:
        """Best score of each place up to ``stop`` and where its last piece begins.

        Pieces begin before ``end``; ``entry`` holds the places to begin at.
        """
        best, back = [_LOST] * (stop + 1), [-1] * (stop + 1)
        for i, v in entry.items():
            best[i] = v
        root, chars, missing = self.root, list(s[:stop]), self.missing
        for i in range(end):
            here = best[i]
            if here == _LOST:
                continue
            node = root.get(chars[i])
            if (node is None or node[0] is None) and here + missing > best[i + 1]:
                best[i + 1], back[i + 1] = here + missing, i
            j = i + 1
            while node is not None:
                if node[0] is not None and here + node[0] > best[j]:
                    best[j], back[j] = here + node[0], i  # the first to reach a sum is the longest piece
                if j == stop:
                    break
                node = node[2].get(chars[j])
                j += 1
        return best, back

    def ids(self, s: str, cuts: list[int]) -> list[int]:
        """Ids of the pieces between consecutive ``cuts``; bytes where there is none."""
        out = []
        for i, j in zip(cuts, cuts[1:]):
            got = self.rank.get(s[i:j])
            out.extend([got[1]] if got is not None else [self.byte_ids[b] for b in s[i:j].encode("utf-8", "replace")])
        return out

    def trace(self, s: str) -> tuple[float, bytes]:
        """Score and packed ids of one text that stands alone."""
        n, root, missing = len(s), self.root, self.missing
        best, back, what = [0.0] + [_LOST] * n, [0] * (n + 1), [-1] * (n + 1)
        chars = list(s)
        for i in range(n):
            here = best[i]
            node = root.get(chars[i])
            j = i + 1
            if (node is None or node[0] is None) and here + missing > best[j]:
                best[j], back[j], what[j] = here + missing, i, -1
            while node is not None:
                score = node[0]
                if score is not None and here + score > best[j]:
                    best[j], back[j], what[j] = here + score, i, node[1]
                if j == n:
                    break
                node = node[2].get(chars[j])
                j += 1
        out, j = [], n
        while j:
            i = back[j]
            if what[j] >= 0:
                out.append(what[j])
            else:
                out += [self.byte_ids[b] for b in reversed(s[i:j].encode("utf-8", "replace"))]
            j = i
        out.reverse()
        return best[n], array("i", out).tobytes()

    def decode(self, ids) -> str:
        """Text of a sequence of ids."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text.get(i, ""))
        out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], {}
    for i in range(m.vocab_size()):
        if m.is_byte(i):
            byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces.append((m.id_to_piece(i), i, m.get_score(i)))
    return Vocabulary(pieces, byte_ids)


class Encoder:
    """Encodes texts and chunks with words memoised."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._word = re.compile(f"{MARK}+[^{MARK}{v.lone}]*|[{v.lone}]|[^{MARK}{v.lone}]+" if v.lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

        class Memo(dict):
            """Words seen of late; two generations, so that frequent words stay."""

            before: dict = {}

            def __missing__(self, word):
                if len(self) >= _MEMO:
                    self.before = dict(self)
                    self.clear()
                got = self.before.get(word)
                if got is None:
                    got = v.trace(word)[1]
                if len(word) <= 64:
                    self[word] = got
                return got

        self.memo = Memo()

    def whole(self, s: str) -> bytes:
        """Packed ids of a normalised text."""
        if not s:
            return b""
        if not self.v.safe:
            return self.v.trace(s)[1]
        memo = self.memo
        return b"".join(map(memo.__getitem__, self._word.findall(s)))

    def _safe(self, s: str, low: int, high: int) -> int | None:
        """First place in ``low..high`` that every path passes."""
        if self.v.safe:
            at = max(low, 1)
            while (at := s.find(MARK, at, high + 1)) >= 0:
                if s[at - 1] != MARK:
                    return at
                at += 1
        return None

    def frame(self, s: str, size: int) -> tuple[int, int] | None:
        """First and last safe place of a chunk of ``size`` characters, past all entry states."""
        first = self._safe(s, self.v.longest - 1, size - 1)
        if first is None:
            return None
        last = first
        at = size
        while (at := s.rfind(MARK, first + 1, at)) > first:
            if s[at - 1] != MARK:
                return first, at
        return first, last

    def matrix(self, s: str, size: int) -> np.ndarray:
        """Best scores from entry state to exit state; ``s`` runs on past ``size`` by a piece less one."""
        k = self.v.longest
        out = np.full((k, k), _LOST)
        at = self.frame(s, size)
        if at is not None:
            first, last = at
            middle = sum(self.v.trace(w)[0] for w in self._word.findall(s[first:last]))
            tail = self._tail(s, last, 0.0, size)
        for i in range(k):
            if i >= size:
                if i - size < k:
                    out[i, i - size] = 0.0
            elif at is None:
                best, _ = self.v.forward(s, {i: 0.0}, size, len(s))
                out[i, : len(s) - size + 1] = best[size:]
            else:
                head = self.v.forward(s[:first], {i: 0.0}, first, first)[0][first]
                out[i, : len(tail)] = head + middle + tail
        return out

    def _tail(self, s: str, last: int, score: float, size: int) -> np.ndarray:
        best, _ = self.v.forward(s[last:], {0: score}, size - last, len(s) - last)
        return np.array(best[size - last :])

    def traces(self, s: str, size: int, entry: np.ndarray) -> tuple[bytes, dict[int, tuple[int, bytes]]]:
        """Ids that all exits share, and for each exit state its entry state and further ids."""
        v, out, lead = self.v, {}, b""
        scores = {i: float(x) for i, x in enumerate(entry) if x > _LOST}
        if not scores:
            return lead, out
        at = self.frame(s, size)
        first, last = at if at is not None else (0, 0)
        if at is not None:
            head_best, head_back = v.forward(s[:first], scores, first, first)
            if head_best[first] == _LOST:
                return lead, out
            cuts = self._back(head_back, first)
            start = cuts[0]
            lead = array("i", v.ids(s, cuts)).tobytes() + b"".join(map(self.memo.__getitem__, self._word.findall(s[first:last])))
            scores = {0: 0.0}
        best, back = v.forward(s[last:], scores, size - last, len(s) - last)
        for j in range(len(s) - size + 1):
            end = size - last + j
            if best[end] > _LOST:
                cuts = self._back(back, end)
                out[j] = (start if at is not None else cuts[0], array("i", v.ids(s[last:], cuts)).tobytes())
        return lead, out

    @staticmethod
    def _back(back: list[int], end: int) -> list[int]:
        cuts = [end]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        return cuts[::-1]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def entry_scores(m: np.ndarray, block: int = 256) -> np.ndarray:
    """Scores of every chunk's entry states from the matrices of the chunks, ``block`` of them scanned at a time."""
    entry = np.full((len(m), m.shape[1]), _LOST)
    entry[0, 0] = 0.0
    for s in range(0, len(m), block):
        part = prefix_scan(m[s : s + block])
        after = (entry[s][None, :, None] + part).max(axis=1)
        entry[s + 1 : s + 1 + len(part)] = after[: len(m) - s - 1]
    return entry


def prefix_scan(m: np.ndarray) -> np.ndarray:
    """Inclusive max-plus prefix products of a stack of matrices, in log2(n) parallel rounds."""
    out, step = m.copy(), 1
    while step < len(out):
        out[step:] = max_plus(out[:-step], out[step:])
        step *= 2
    return out


def normalise(text: str | None) -> str:
    """The text as the pieces see it."""
    return MARK + text.replace(" ", MARK) if text else ""


def encode(docs: DataFrame, path: str, chunk: int = 65_536) -> DataFrame:
    """``(doc_id, text, ids)``: ids of every whole text as little-endian 32-bit integers."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(batches):
        enc = Encoder(vocabulary(path))
        for b in batches:
            ids = [None if t is None else enc.whole(normalise(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    def slices(batches):
        reach = vocabulary(path).longest - 1
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = normalise(t)
                for n, at in enumerate(range(0, len(s), chunk)):
                    part = s[at : at + chunk + reach]
                    cols = [[row], [n], [min(chunk, len(s) - at)], [part]]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "n", "size", "part"])

    def matrices(batches):
        enc = Encoder(vocabulary(path))
        for b in batches:
            got = [enc.matrix(p, z).tobytes() for p, z in zip(b.column("part").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(got, pa.binary())], names=["row", "n", "matrix"])

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        k = vocabulary(path).longest
        m = np.frombuffer(b"".join(group["matrix"].to_pylist()), dtype=np.float64).reshape(-1, k, k)
        entry = entry_scores(m)
        return pa.table({"row": group["row"], "n": group["n"], "entry": pa.array([e.tobytes() for e in entry], pa.binary())})

    def trace(batches):
        enc = Encoder(vocabulary(path))
        for b in batches:
            rows = []
            for row, n, size, part, entry in zip(*(b.column(c).to_pylist() for c in ("row", "n", "size", "part", "entry"))):
                lead, exits = enc.traces(part, size, np.frombuffer(entry, dtype=np.float64))
                rows.append((row, n, lead, list(exits), [e for e, _ in exits.values()], [i for _, i in exits.values()]))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "n", "lead", "leave", "enter", "ids"])

    def choose(group: pa.Table) -> pa.Table:
        state, out = 0, []
        for r in group.sort_by([("n", "descending")]).to_pylist():
            at = r["leave"].index(state)
            out += [r["ids"][at], r["lead"]]
            state = r["enter"][at]
        return pa.table({"row": group["row"][:1], "ids": pa.array([b"".join(out[::-1])], pa.binary())})

    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of their own: few small rows, much work each
    small = base.where(~giant).mapInArrow(short, "doc_id long, text string, ids binary")
    large = cut(base.where(giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    parts = cut(large.select("row", "text").mapInArrow(slices, "row long, n int, size int, part string").repartition(wide, "row", "n"))
    entries = parts.mapInArrow(matrices, "row long, n int, matrix binary").groupBy("row").applyInArrow(scan, "row long, n int, entry binary")
    traced = parts.join(entries, ["row", "n"]).repartition(wide, "row", "n").mapInArrow(trace, "row long, n int, lead binary, leave array<int>, enter array<int>, ids array<binary>")
    chosen = traced.groupBy("row").applyInArrow(choose, "row long, ids binary")
    return small.unionAll(large.join(chosen, "row").select("doc_id", "text", "ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""

    def run(batches):
        v = vocabulary(path)
        size = 1 + max([*v.text, *v.byte], default=0)
        plain = [v.text.get(i, "") if v.byte.get(i, 128) >= 128 else chr(v.byte[i]) for i in range(size)]
        joined = np.array([v.byte.get(i, 0) >= 128 for i in range(size)])  # bytes that only make a character together
        for b in batches:
            got = []
            for ids in b.column("ids").to_pylist():
                if ids is None:
                    got.append(None)
                    continue
                a = np.frombuffer(ids, dtype="<i4")
                if joined[a].any():
                    got.append(v.decode(a.tolist()))
                else:
                    t = "".join(map(plain.__getitem__, a.tolist())).replace(MARK, " ")
                    got.append(t[1:] if t[:1] == " " else t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode it again: counts, digests and whether the text came back."""
    bounded_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = decode(encode(table(spark, sf_dir, "documents"), path), path)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_pieces")
    return got.select("doc_id", n, F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))
