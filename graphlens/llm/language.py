"""Operator 6: language identification by script ranges and Viterbi over words.

Fit: over labelled rows, a bounded sample (``sample`` rows of the smallest
hashes, a documented parameter) gives every learned language all its character
2- and 3-gram counts; a word's score for a language is the mean log-probability
of its n-grams, add-one smoothed, times the square root of its length.

Predict: a word's script (from code-point ranges) keeps only the languages
learned with that script as candidates; Viterbi over the words' scores with a
switching penalty labels every word, so runs of one label are the spans of a
mixed-language text; a word of more than 64 letters is several steps. The
text's language is the label with most letters; the score is that label's share
of letters times its words' mean posterior.

Edge cases: null text or text without a letter is ``und`` with score 0 and no
span; with no labelled row everything is ``und``; a word whose script no
language was learned with may be any; ties go to the first language by name;
empty tables give empty results; very long texts are labelled in full. Letters
are Unicode's: a fraction or a superscript is none, and a combining mark belongs
to the word of the letter before it.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, cut, pieces, table


def _ranges(major: str, low: int, high: int) -> str:
    """Code points of one major category from ``low`` to ``high``, as the inside of a character class."""
    hit = np.array([unicodedata.category(chr(c))[0] == major for c in range(low, high)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return "".join(f"\\U{low + a:08x}-\\U{low + b - 1:08x}" for a, b in edges.reshape(-1, 2))


@functools.cache
def _word_pattern(high: int) -> re.Pattern:
    """A letter, then letters and combining marks, among the code points below ``high``."""
    letter = _ranges("L", 0, high)
    return re.compile(f"[{letter}][{letter}{_ranges('M', 0, high)}]*")


def word_pattern(text: str) -> re.Pattern:
    """The pattern of words; the one for all planes is slower, so only texts that need it get it."""
    wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
    return _word_pattern(sys.maxunicode + 1 if wide else 0x10000)


def has_letter(text: str | None) -> bool:
    """Whether a text has a word."""
    return bool(text) and word_pattern(text).search(text) is not None


#: First code points of script blocks, and the script that begins there.
_SCRIPTS = [
    (0x0000, "Latn"), (0x0370, "Grek"), (0x0400, "Cyrl"), (0x0530, "Armn"), (0x0590, "Hebr"), (0x0600, "Arab"),
    (0x0700, "Othr"), (0x0900, "Deva"), (0x0980, "Beng"), (0x0A00, "Othr"), (0x0E00, "Thai"), (0x0E80, "Othr"),
    (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Othr"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, "Othr"),
    (0x3040, "Kana"), (0x3100, "Hani"), (0xA4D0, "Othr"), (0xAC00, "Hang"), (0xD7B0, "Othr"), (0xF900, "Hani"), (0xFB00, "Othr"),
]
_STARTS = np.array([s for s, _ in _SCRIPTS])
#: Distinct words kept with their scores in a worker.
_MEMO = 150_000
#: Letters of a Viterbi step; a longer run without spaces is cut into steps, none of its letters is left out.
_STEP = 64


def steps(word: str) -> list[str]:
    """``word``, or the consecutive pieces of a word of more than ``_STEP`` letters.

    A piece begins with a zero, then its part of the word between boundary
    marks and the two characters after it, so the n-grams that begin in the
    pieces are those of the whole word.
    """
    if len(word) <= _STEP:
        return [word]
    w, n = f"^{word}$", len(word)
    return ["\0" + (w[s:] if s + _STEP >= n else w[s : s + _STEP + 2]) for s in range(0, n, _STEP)]


def letters(step: str) -> int:
    """Letters of a word or of a long word's piece."""
    if step[0] != "\0":
        return len(step)
    return len(step) - 2 if step[-1] == "$" else _STEP - (step[1] == "^")


def places(m: re.Match) -> list[tuple[int, int]]:
    """Start and end of each step of the word found by ``m``."""
    low = m[0].lower()
    if len(low) <= _STEP:
        return [m.span()]
    ends = list(accumulate(len(c.lower()) for c in m[0]))
    cuts = [0, *(bisect_right(ends, s - 1) for s in range(_STEP, len(low), _STEP)), len(m[0])]
    return [(m.start() + i, m.start() + j) for i, j in zip(cuts, cuts[1:])]


def script(word: str) -> str:
    """Script of the first letter of a word or piece."""
    return _SCRIPTS[int(np.searchsorted(_STARTS, ord(word.lstrip("\0^")[0]), side="right")) - 1][1]


def grams(word: str) -> list[str]:
    """Character 2- and 3-grams of a word between boundary marks, or those that begin in a piece."""
    w, own = (word[1:], _STEP) if word[0] == "\0" else (f"^{word}$", len(word) + 2)
    if w[-1] == "$":
        own = len(w)
    return [w[i : i + n] for n in (2, 3) for i in range(min(own, len(w) - n + 1))]


class Model:
    """Per-language n-gram scores and the scripts each language was learned with."""

    def __init__(self, langs: list[str], rows: dict[str, int], scores: np.ndarray, scripts: dict[str, list[int]]):
        """``scores`` has a row for each n-gram in ``rows``; row 0 is that of unseen n-grams."""
        self.langs, self.rows, self.scores, self.scripts = langs, rows, scores, scripts

    def words(self, words: list[str]) -> np.ndarray:
        """Log-scores of words in each language; other scripts' languages are out of the race."""
        if not words:
            return np.zeros((0, max(1, len(self.langs))), dtype=np.float32)
        get = self.rows.get
        flat, sizes = [], []
        for w in words:
            got = [get(g, 0) for g in grams(w)]
            flat += got
            sizes.append(len(got))
        n = np.array(sizes)
        sums = np.add.reduceat(self.scores[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
        s = sums / n[:, None] * np.sqrt(n / 2)[:, None]
        s -= s.max(axis=1, keepdims=True)
        for i, w in enumerate(words):
            known = self.scripts.get(script(w)) if not w.lstrip("\0^")[0].isascii() or len(self.scripts) > 1 else None
            if known is not None and len(known) < len(self.langs):
                row = np.full(len(self.langs), -50.0)
                row[known] = s[i, known] - s[i, known].max()
                s[i] = row
        return s.astype(np.float32)


def fit(labelled: DataFrame, sample: int = 1000) -> Model:
    """Learn from ``labelled(text, lang)``: at most ``sample`` distinct rows, every n-gram of theirs.

    The rows with the smallest hashes are taken, a choice that doesn't depend
    on the input's order. Their greatest hash is found first, from hashes
    alone, so no text but the sample's is moved.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang").withColumn("h", F.xxhash64("text", "lang"))
    top = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(top).cast("long")).dropDuplicates(["h"]).select("text", "lang").repartition(16, "text")

    def count(batches):
        words: Counter = Counter()
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = t.lower()
                words.update((lang, w) for w in word_pattern(low).findall(low))
        got: Counter = Counter()
        for (lang, w), n in words.items():
            for step in steps(w):
                got[lang, "", script(step)] += n
                for g in grams(step):
                    got[lang, g, ""] += n
        keys = list(got)
        for s in range(0, len(keys), 10_000):
            part = keys[s : s + 10_000]
            cols = [pa.array([k[i] for k in part], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([got[k] for k in part], pa.int64())], names=["lang", "gram", "script", "n"])

    counts = cut(rows.mapInArrow(count, "lang string, gram string, script string, n long").groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")))
    # bounded by the sample: its distinct n-grams, and a row per language and script
    got = counts.where("gram <> ''").collect()
    seen = counts.where("gram = ''").collect()
    langs = sorted({r["lang"] for r in seen})
    place = {x: i for i, x in enumerate(langs)}
    index = {g: i for i, g in enumerate(sorted({r["gram"] for r in got}), 1)}
    n = np.ones((len(index) + 1, max(1, len(langs))))
    for r in got:
        n[index[r["gram"]], place[r["lang"]]] += r["n"]
    scores = np.log(n) - np.log(n.sum(axis=0))
    words = {x: sum(r["n"] for r in seen if r["lang"] == x) for x in langs}
    scripts: dict[str, list[int]] = {}
    for r in seen:
        if r["n"] >= 0.01 * words[r["lang"]]:
            scripts.setdefault(r["script"], []).append(place[r["lang"]])
    return Model(langs, index, scores, {s: sorted(set(v)) for s, v in scripts.items()})


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label sequence of each text; texts advance together, one word a step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list = [np.zeros(0, dtype=np.int16)] * len(scores)
    if not len(order) or not lengths[0]:
        return out
    k, steps = scores[order[0]].shape[1], int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    ends = np.cumsum(alive)
    flat = np.zeros((int(ends[-1]), k), dtype=np.float32)  # step-major, the longest texts first
    firsts = ends - alive
    for r, i in enumerate(order):
        if lengths[r]:
            flat[firsts[: lengths[r]] + r] = scores[i]
    came = np.zeros((int(ends[-1]),), dtype=np.int16)  # best label of the step before
    stay = np.zeros((int(ends[-1]), k), dtype=bool)
    now = flat[: alive[0]].copy()
    lasts: list = [None] * len(order)
    for t in range(1, steps + 1):
        live = int(alive[t]) if t < steps else 0
        for r in range(live, len(now)):  # texts that end here
            lasts[r] = int(np.argmax(now[r]))
        if not live:
            break
        now = now[:live]
        best = now.argmax(axis=1)
        jump = now[np.arange(live), best] - penalty
        at = slice(int(firsts[t]), int(firsts[t]) + live)
        came[at] = best
        stay[at] = now >= jump[:, None]
        now = np.where(stay[at], now, jump[:, None]) + flat[at]
    labels = np.zeros(int(ends[-1]), dtype=np.int16)
    now_label = np.zeros(int(alive[0]), dtype=np.int64)
    for r in range(int(alive[0])):
        now_label[r] = lasts[r]
    for t in range(steps - 1, -1, -1):
        live = int(alive[t])
        at = int(firsts[t]) + np.arange(live)
        labels[at] = now_label[:live]
        if t:
            kept = stay[at, now_label[:live]]
            now_label[:live] = np.where(kept, now_label[:live], came[at])
    for r, i in enumerate(order):
        out[i] = labels[firsts[: lengths[r]] + r]
    return out


def _predict(model: Model, penalty: float, spans: bool, names: tuple[str, ...], held: int = 6_000_000):
    class Index(dict):
        """Words to rows of the score table, numbered as they come."""

        def __missing__(self, word):
            n = self[word] = len(self)
            return n

    def run(batches):
        k = len(model.langs)
        index, known, size = Index(), model.words([]), np.zeros(0, dtype=np.int64)

        def solve(texts):
            nonlocal index, known, size
            if len(index) > _MEMO:
                index, known, size = Index(), model.words([]), np.zeros(0, dtype=np.int64)
            at = []
            for t in texts if k else [""] * len(texts):
                t = t or ""
                low = t if "\u0130" in t else t.lower()  # that letter becomes two in lower case
                words = word_pattern(low).findall(low)
                if low is t:
                    words = [w.lower() for w in words]
                if max(map(len, words), default=0) > _STEP:
                    words = [x for w in words for x in steps(w)]
                at.append(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)))
            new = list(index)[len(known) :]
            known = np.concatenate([known, model.words(new)])
            size = np.concatenate([size, np.fromiter(map(letters, new), dtype=np.int64, count=len(new))])
            post = np.exp(known)
            post /= post.sum(axis=1, keepdims=True)
            langs, scores, runs = [], [], []
            for a, y, t in zip(at, viterbi([known[a] for a in at], penalty), texts):
                if not len(a):
                    langs.append("und")
                    scores.append(0.0)
                    runs.append([])
                    continue
                n = size[a]
                share = np.bincount(y, weights=n, minlength=k)
                best = int(np.argmax(share))
                mine = y == best
                langs.append(model.langs[best])
                scores.append(float(share[best] / share.sum() * np.average(post[a[mine], best], weights=n[mine])))
                if spans:
                    spots = [x for m in word_pattern(t).finditer(t) for x in places(m)]
                    cuts = [0, *(np.flatnonzero(y[1:] != y[:-1]) + 1).tolist(), len(y)]
                    runs.append([{"start": spots[s][0], "end": spots[e - 1][1], "lang": model.langs[y[s]]} for s, e in zip(cuts, cuts[1:])])
            cols = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                cols.append(pa.array(runs, kind))
            return cols

        added = names[: 2 + spans]
        buffer, chars = [], 0

        def flush():
            b = pa.Table.from_batches(buffer).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*b.columns, *solve(b.column("text").to_pylist())], names=[*b.schema.names, *added])

        for b in pieces(batches):
            buffer.append(b)
            chars += pc.sum(pc.utf8_length(b.column("text"))).as_py() or 0
            if chars > held:  # texts advance together, so a few large groups take the fewest steps
                yield flush()
                buffer, chars = [], 0
        if buffer:
            yield flush()

    return run


def predict(docs: DataFrame, model: Model, penalty: float = 4.0, spans: bool = False, names: tuple[str, ...] = ("lang_pred", "score", "spans")) -> DataFrame:
    """``docs`` with the language, its score and, on request, spans of labelled text added under ``names``.

    A column of ``docs`` that has one of these names gives way.
    """
    kinds = ("string", "double", "array<struct<start:int,end:int,lang:string>>")[: 2 + spans]
    added = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    base = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_predict(model, penalty, spans, names), f"{schema}, {added}")


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, by the rule that finds words."""

    def run(batches):
        for b in pieces(batches):
            yield b.filter(pa.array([has_letter(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """Whether a document is kept out of the fit: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learn from the documents that are not held out, predict all."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    got = predict(docs.select("doc_id", "text"), model, spans=True)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
