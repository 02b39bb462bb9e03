"""The contract queries, called as registered, against plain versions that share no code with them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from graphlens.llm import queries

AWKWARD = [None, "", " ", "a@b.c 1.2.3.4 +1 (555) 555-2485", "4111 1111 1111 1111", "A b C", "a B c", "x" * 5000, "é 漢 😀 \n\t z", "1.2.3.4.5.6.7.8 256.1.1.1"]


@pytest.fixture(scope="module")
def case(spark, sf_dir, tmp_path_factory):
    """A folder of tables: documents with awkward texts added, pages with awkward urls added; and both as plain rows."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = docs.agg({"doc_id": "max"}).first()[0]
    extra = spark.createDataFrame([(last + 1 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).repartition(3).write.parquet(f"{where}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    last = pages.agg({"page_id": "max"}).first()[0]
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12#f", "http://foo.com/fr/", "http://foo.com/de/x", "http://xcom/de/", None, "nothing", "ftp://h.org", "http://notexample.org/es/"]
    extra = spark.createDataFrame([(last + 1 + i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages.unionByName(extra, allowMissingColumns=True).write.parquet(f"{where}/pages.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{where}/labels.parquet")
    rows = {n: pq.read_table(f"{where}/{n}.parquet").to_pylist() for n in ("documents", "pages")}
    return where, rows


def ran(spark, case, name):
    return queries.queries()[name](spark, case[0]).collect()


def texts(case):
    return {r["doc_id"]: r["text"] or "" for r in case[1]["documents"]}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_op1(spark, case):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".") if kind == "ip"), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    want = texts(case)
    got = ran(spark, case, "op1_pii")
    assert Counter(r["doc_id"] for r in got) == Counter(want.keys())
    for r in got:
        base = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, want[r["doc_id"]]) if holds(k, m[0]))
        joined = [f"{k}:{s}:{e}" for s, _, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(b[2] == k for b in base) for k in kinds]
        spans = r["spans"].split(",") if r["spans"] else []
        assert not Counter(joined) - Counter(spans) and [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        assert r["n_spans"] == len(spans) and r["n_added"] == len(spans) - len(base)


def test_op2(spark, case):
    rules = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
    want = {r["page_id"]: r["url"] for r in case[1]["pages"]}
    got = ran(spark, case, "op2_url_filter")
    assert Counter(r["page_id"] for r in got) == Counter(want.keys())
    for r in got:
        host = path = ""
        if want[r["page_id"]] and "://" in want[r["page_id"]]:
            host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", want[r["page_id"]].split("://", 1)[1], re.S).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == best[2] if fits else r["verdict"] in ("allow", "block")


def test_op4(spark, case):
    want = texts(case)
    got = ran(spark, case, "op4_media_columns")
    assert Counter(r["doc_id"] for r in got) == Counter(want.keys())
    by_text = {}
    for r in got:
        raw = want[r["doc_id"]].encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        assert by_text.setdefault(raw, (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_op6(spark, case):
    langs = {r["lang"] for r in case[1]["documents"] if r["lang"]}
    truth = {r["doc_id"]: r["lang"] for r in case[1]["documents"]}
    want, hits = texts(case), []
    got = ran(spark, case, "op6_language_id")
    assert Counter(r["doc_id"] for r in got) == Counter(want.keys())
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in want[r["doc_id"]])) and r["lang_pred"] in langs | {"und"}
        if r["held_out"] and truth[r["doc_id"]]:
            hits.append(r["lang_pred"] == truth[r["doc_id"]])
    assert sum(hits) >= 0.95 * len(hits)


def test_op7(spark, case):
    want, prints = texts(case), {}
    for i, t in want.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(t.encode()).lower())
        shingles = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    v = np.array([prints[i] for i in ids], dtype=np.uint64)
    near, label = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3, np.arange(len(ids))
    while True:
        low = np.where(near, label[None, :], len(ids)).min(1)
        if (low == label).all():
            break
        label = low
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in ran(spark, case, "op7_simhash_near_dedup")}
    assert got == {i: (f"{prints[i]:016x}", ids[label[n]]) for n, i in enumerate(ids)}


def test_op8(spark, case):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, by_doc, by_seq = texts(case), {}, {}
    for r in ran(spark, case, "op8_packing"):
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        ids, at = [*tok.encode(want[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
