"""The pipeline's stages against brute force on a small corpus."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import jaccard

DOCS = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(odd)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "mixing", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, DOCS).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = docs
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {90001, 90002}
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for k, t in rows for w in [t.encode().lower().split()]}
            kept = {r.doc_id for r in docs.collect()}
            comp = {r.doc_id: r.component_id for r in jaccard.components(before).collect()}
            assert kept == {k for k in comp if comp[k] == k} and len(kept) < len(rows)
            for a in kept:
                assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in kept)
        if name == "mixing":
            n = collections.Counter(r.doc_id for r in docs.collect())
            assert set(n) == kept and max(n.values()) <= 2
        if name != "packing":
            assert docs.columns == before.columns
    pieces = out["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == kept
    whole = out["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max("offset") + F.max_by("length", "offset")).alias("end"))
    assert whole.where("n > 1024 OR n <> end").count() == 0


def test_language_id_keeps_documents_where_no_lang_is_given(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "été", None)], "doc_id long, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, DOCS)
    assert got.columns == docs.columns and sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, None), (4, None)]


CLASHING = ["_lang", "_SCORE", "__lang", "lang_pred", "_mix_block", "_tokens", "c0", "component_id", "n_shingles", "start", "offset", "hash"]


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names; then the same columns without rows."""
    long = " ".join(f"w{i % 971}" for i in range(20_000))
    rows = [(1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, long, None, "b", 2), (5, "one two three four five six", "en", "a", 1)]
    rows += [(6, "ein zwei drei vier acht", "de", None, 1)] * 2 + [(None, "ein wort ohne nummer", "de", "b", 1), (8, "12 34", "en", "b", 1), (9, long + " tail", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in CLASHING})
    kept = {"language_id": [None, 1, 4, 5, 6, 6, 9], "jaccard_join": [None, 1, 2, 3, 4, 6, 8]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, none = stage(spark, docs, DOCS), stage(spark, docs.limit(0), DOCS)
        assert out.columns == none.columns == docs.columns and none.count() == 0
        got = out.collect()
        assert all(r[n] == n for r in got for n in CLASHING), name
        ids = sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
        if name in kept:
            assert ids == kept[name]
        else:
            n, before = collections.Counter(ids), collections.Counter(r[0] for r in rows)
            assert set(n) == set(before) and all(before[k] <= n[k] <= 2 * before[k] for k in n)
    pieces = corpus_pipeline.pack_sequences(spark, docs, DOCS).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows} and sum(r.start == 0 for r in pieces) == len(rows)
    assert [(r.length, r.doc_tokens) for r in pieces if r.doc_id in (2, 3)] == [(1, 1)] * 2
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), DOCS).count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DOCS)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0
