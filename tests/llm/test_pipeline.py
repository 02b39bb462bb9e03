"""The pipeline against its stages written out plainly."""

import re
from collections import defaultdict

import corpus_pipeline
from graphlens.llm import language, pii
from tests.llm.test_operators import plain_line_dedup


def plain_groups(texts, least=0.8):
    """Smallest id of each group tied by five-word shingle similarity, and the linked pairs; no code of the operator."""
    sets, held = {}, defaultdict(list)
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {""}
        for x in sets[i]:
            held[x].append(i)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    label = {i: i for i in texts}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, links


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == cols
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert kept[name] == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
            given = {r["doc_id"]: r["lang"] for r in docs.collect()}
            said = {r["doc_id"]: r["lang"] for r in out.collect()}
            assert set(said.values()) <= set(given.values()) and sum(said[i] == given[i] for i in said) >= 0.98 * len(said)
        elif name == "line_dedup":
            want = plain_line_dedup(before, 50)
            assert kept[name] == {i: t for i, t in want.items() if re.search(r"\w", t)}
        elif name == "near_dedup":
            label, links = plain_groups(before)
            gone = set(before) - set(kept[name])
            assert all(label[i] != i for i in gone)  # only documents similar to one that stays in their group
            assert len(gone) >= 0.95 * sum(label[i] != i for i in before)
        elif name == "pii":
            assert pii.find(out).where("size(__all) > 0").count() == 0
            assert set(kept[name]) == set(before)
            assert all(t == before[i] for i, t in kept[name].items() if not re.search(r"@|\+\d|\d{9}|\d\.\d", before[i]))
        else:
            total = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
            assert set(total) == set(before) and all(r["doc_tokens"] == total[r["doc_id"]] for r in out.select("doc_id", "doc_tokens").distinct().collect())
        docs = out
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.count() == docs.count()


def test_language_stage_without_labels_keeps_texts(spark, sf_dir):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some text", None, "", "12 3", "日本"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify(spark, docs, sf_dir).collect()) == [0, 4]
    labelled = docs.withColumn("doc_id", docs["doc_id"] + 100).withColumn("lang", docs["text"])
    out = labelled.where(language.held_out(labelled["doc_id"]))
    assert {r["doc_id"] for r in corpus_pipeline.identify(spark, out, sf_dir).collect()} == {r["doc_id"] for r in out.where("doc_id in (100, 104)").collect()}


def test_near_dedup_stage_on_repeated_and_missing_ids(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    long, near, other = " ".join(words), " ".join(words[:-1] + ["z"]), " ".join(reversed(words))
    rows = [(1, long), (1, long), (1, other), (2, near), (None, long), (None, None), (3, None), (4, ""), (5, other + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup_documents(spark, docs.withColumn("component", docs["lang"]).withColumn("__hash", docs["lang"]), sf_dir)
    assert got.columns == [*docs.columns, "component", "__hash"]
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in got.collect()) == sorted([(1, long), (1, other), (-1, long), (-1, ""), (3, "")])


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
