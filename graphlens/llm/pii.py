"""Operator 1: personal data by patterns, checksum validators and context words.

Built-in column functions only. Every kind has a pattern that proposes spans
and a validator that confirms them (octet range, Luhn, digit counts, mod 97).
A span's score is its kind's own score, raised by a word of that kind within
``near`` characters and lowered by a word that speaks against it. The contract's
base spans stay whatever their score; the method's own spans are kept from
``threshold`` on: iban (by each country's length, mod-97 confirmed), ssn (the
3-2-4 digit form, too weak without a context word), secret (keys of well-known
forms, and long mixed tokens beside a context word), and cards and phone numbers
in a tight form where the plain pattern ran two numbers together.

Positions: ``split`` gives the text between matches and ``regexp_extract_all``
the matches, both in order; running sums of their lengths are the starts, in
code points. Possessive quantifiers and look-behinds leave the matches as the
plain patterns give them, but without backtracking, so a long run of one
character costs linear time and no stack.

Edge cases: null text is empty and has no spans; empty and very long texts are
searched whole; repeated rows are alike; an empty table gives an empty result;
``redact`` keeps every other column, but for ones named ``__base``, ``__all``
or ``__merged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base kinds: leftmost, non-overlapping, as in the contract.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of the added spans. The tight forms find numbers that the plain ones
#: run together with a neighbour and so drop.
TIGHT = {
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"\+1[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])",
}
#: Number of characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Country, two check digits and the rest in that country's length, in groups of four or run together."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


IBAN = _iban()
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Keys of well-known forms, and tokens of letters and digits that only a context word makes a secret.
KEY = r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{20,80}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,128}+(?![A-Za-z0-9])"
#: Score of a kind without any context, and the words that raise and lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
RAISE, LOWER = 0.3, 0.3
WORDS = {
    "email": ["mail", "contact", "write to"],
    "ip": ["address", "host", "server", r"\bip\b"],
    "card": ["card", "visa", "credit", "debit", "tarjeta", "karte", "carte"],
    "phone": ["phone", r"\btel", "call", "mobile", "fax", "telefon", "tel[eé]fono"],
    "iban": ["iban", "account", "konto", "cuenta", "compte", "bank"],
    "ssn": ["ssn", "social security", "tax id", "taxpayer"],
    "secret": ["token", "secret", r"api[ _-]?key", "passw", "credential", "bearer", r"\bauth"],
}
AGAINST = {
    "ip": ["version", "release", "section"],
    "card": ["order", "invoice", "tracking", "serial", "isbn"],
    "phone": ["order", "invoice", "tracking", "serial", "isbn"],
    "ssn": ["order", "invoice", "part number"],
    "secret": ["commit", "checksum", r"\bsha", r"\bmd5"],
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    odd = F.regexp_extract_all(F.reverse(digits), F.lit("([0-9])([0-9])?"), F.lit(1))
    even = F.regexp_extract_all(F.reverse(digits), F.lit("([0-9])([0-9])"), F.lit(2))
    total = F.aggregate(odd, F.lit(0), lambda a, d: a + d.cast("int"))
    twice = F.aggregate(even, F.lit(0), lambda a, d: a + F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return (total + twice) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97 after the usual rotation."""
    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    code = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda a, ch: (a * F.when(ch.rlike("[0-9]"), 10).otherwise(100) + code(ch)) % 97
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), step) == 1


def octets(text: Column) -> Column:
    """Whether the four dotted parts are at most 255."""
    return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return octets(m)
    if kind == "card":
        n = F.length(_digits(m))
        return (n >= 14) & (n <= 19) & luhn(_digits(m))
    if kind == "phone":
        n = F.length(_digits(m))
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return mod97(bare)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, hint: Column, rank: int) -> Column:
    """``array<struct<start, rank, end, kind>>`` of the valid matches; ``hint`` is a cheap precondition."""
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        kept = F.when(_valid(kind, pair["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(between) - 1, F.lit(0))), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])
    return F.when(hint, walked).otherwise(empty)


def _scored(text: Column, spans: Column, near: int, own: float | None = None) -> Column:
    """``spans`` with their scores; ``own`` in place of the kind's score without context."""

    def score(s: Column) -> Column:
        first = F.greatest(s["start"] - near, F.lit(0))
        around = F.lower(F.concat(F.substring(text, first + 1, s["start"] - first), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(near))))
        out = F.lit(0.0)
        for kind, base in SCORES.items():
            value = F.lit(base if own is None else own) + F.when(around.rlike("|".join(WORDS[kind])), RAISE).otherwise(0.0)
            if kind in AGAINST:
                value -= F.when(around.rlike("|".join(AGAINST[kind])), LOWER).otherwise(0.0)
            out = F.when(s["kind"] == kind, value).otherwise(out)
        return F.round(F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)), 1)

    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), score(s).alias("score")))


def find(docs: DataFrame, threshold: float = 0.6, near: int = 40) -> DataFrame:
    """``docs`` with ``__base`` and ``__all``: sorted spans of the base kinds, and with scores and the method's added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hints = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": F.instr(text, "+") > 0}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    base = [_spans(text, k, patterns[k], hints[k], i) for i, k in enumerate(KINDS)]
    free = lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = [_scored(text, F.filter(_spans(text, k, TIGHT[k], hints[k], KINDS.index(k)), free), near) for k in TIGHT]
    more.append(_scored(text, _spans(text, "iban", IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}"), 4), near))
    more.append(_scored(text, _spans(text, "ssn", SSN, text.rlike(r"[0-9]{3}-[0-9]{2}-"), 5), near))
    more.append(_scored(text, _spans(text, "secret", KEY, text.rlike("A[KS]IA|gh[opsu]_|xox[abp]-|-----BEGIN"), 6), near, 0.9))
    more.append(_scored(text, _spans(text, "secret", TOKEN, text.rlike("(?i)" + "|".join(WORDS["secret"])), 6), near))
    got = docs.withColumn("__base", F.array_sort(F.concat(*base)))
    kept = F.filter(F.concat(*more), lambda s: s["score"] >= threshold)
    return got.withColumn("__all", F.array_sort(F.array_distinct(F.concat(_scored(text, F.col("__base"), near), kept))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets.

    Overlapping spans count as one with the first's kind; null text stays null.
    """
    found = find(docs, **options)
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(acc) > 0) & (s["start"] < last["end"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    merged = F.aggregate("__all", none, merge)
    text = F.col("text").cast("string")

    def replace(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate("__merged", start, replace, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = found.withColumn("__merged", merged)
    return out.withColumn("text", F.when(F.size("__merged") > 0, whole).otherwise(text)).drop("__base", "__all", "__merged")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts, digest of the base spans, and all spans of every document with their number and scores."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("__all", lambda s: s["score"].cast("string")), ",")
    number = [F.size("__all").cast("long").alias("n_spans"), (F.size("__all") - F.size("__base")).cast("long").alias("n_added")]
    digest = F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(count(k) for k in KINDS), digest, _joined(F.col("__all")).alias("spans"), scores.alias("scores"), *number)
