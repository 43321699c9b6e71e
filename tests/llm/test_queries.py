"""Registered queries against their SQL, and the pipeline against brute force stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import near_dups
from lotwise.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import brute_leaks, brute_repeats, documents, prose
from tools.check_oracle import compare, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    ok, note, _ = compare(spark, oracle(FOLDER), FOLDER, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_take_odd_documents_and_keep_their_columns(spark):
    shared = prose(60)
    rows = [(1, None), (2, ""), (3, "12 34"), (4, f"{prose(50)} {shared}"), (5, f"{shared} {prose(50)}"), (6, prose(70)), (6, prose(3)), (None, prose(40)), (7, prose(20000))]
    docs = documents(spark, [*rows, (8, rows[5][1]), (8, rows[5][1])])
    for name, run in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = run(spark, given, FOLDER)
            out.collect()
            if name != "bpe":
                assert out.schema.simpleString() == docs.schema.simpleString()
    assert {r["doc_id"] for r in stage("language_id")(spark, docs, FOLDER).collect()} == {4, 5, 6, 7, 8, None}
    kept = stage("near_dedup")(spark, docs.where("doc_id in (6, 8)"), FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == [6, 6]


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in stage("language_id")(spark, docs, FOLDER).collect()]
    assert sorted(r[0] for r in rows) == sorted(r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))
    # Near duplicates: all pairs, by alignment, among texts that share a five-word shingle.
    words = {r[0]: near_dups.normal_words(r[1]) for r in rows}
    ids, parent = sorted(words), {i: i for i in words}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    strong = []
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            one, two = grams[ids[a]], grams[ids[b]]
            both = len(one & two)
            if both / len(one | two) >= 0.8:
                strong.append((ids[a], ids[b]))
            if words[ids[a]] == words[ids[b]] or both and near_dups.similar(words[ids[a]], words[ids[b]]):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    kept = stage("near_dedup")(spark, spark.createDataFrame(rows, docs.schema), FOLDER).collect()
    got = {r["doc_id"] for r in kept}
    assert {i for i in ids if root(i) == i} <= got
    assert all(b not in got or not {a, b} <= got for a, b in strong)
    # Passages, then benchmark windows, then tokens.
    rows = [(r["doc_id"], r["text"]) for r in kept]
    cut = stage("substring_dedup")(spark, spark.createDataFrame([tuple(r) for r in kept], docs.schema), FOLDER)
    want = {i: (n, gone) for i, n, gone, _ in brute_repeats(rows)}
    held = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert {i: len(t.split()) for i, t in held.items()} == {i: n - gone for i, (n, gone) in want.items() if not gone or gone < n}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stage("decontamination")(spark, cut, FOLDER)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in brute_leaks(list(held.items()), items) if not r[5]}
    final = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r["doc_id"] for r in final.collect()) == sorted(r["doc_id"] for r in clean.collect())
    assert final.where(F.col("n_tokens") <= 0).count() == 0


