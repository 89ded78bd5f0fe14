"""The pipeline, each stage against a plain version on what the stage before kept."""

from __future__ import annotations

import zlib

import corpus_pipeline
from eventlens.session import settle
from tests.llm import plain
from tests.llm.test_secrets import KEY
from tests.llm.test_shingles import near, shingles

CLASHES = ["__id", "__key", "__spans", "__dropped", "__score", "score", "dropped_id", "BASE_SPANS", "scope_id"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # planted: an exact copy, near copies of a long text, a secret, and junk
    long = " ".join(f"word{i % 97}x{i % 89}" for i in range(3000))
    planted = [
        (9001, long), (9002, long.replace(" ", "  ", 3)), (9003, long + " tail"), (9004, f"clean text with {KEY} inside it. " + long[:400]),
    ]
    base = docs.filter("length(text) > 0").limit(1).first()
    rows = [(i, t, base["lang"], base["source"], len(t)) for i, t in planted]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, docs, sf), "test")
        if name != "packing":
            assert out.schema.names == docs.schema.names, name
        kept.append({r["doc_id"]: r for r in out.collect()} if name != "packing" else out.collect())
        docs = out if name != "packing" else docs
    quality, exact, close, secrets, pieces = kept
    assert set(quality) <= set(before)
    squeeze = lambda t: "".join(c for c in t or "" if c not in plain.SPACES)
    assert len({squeeze(r["text"]) for r in quality.values()}) == len(exact)
    assert {squeeze(r["text"]) for r in quality.values()} == {squeeze(r["text"]) for r in exact.values()}
    sets = {i: shingles(r["text"]) for i, r in exact.items()}
    groups = plain.components(list(exact), lambda a, b: near(sets[a], sets[b]))
    assert set(close) == set(groups.values())
    assert set(secrets) == set(close)
    if 9004 in secrets:
        assert KEY not in secrets[9004]["text"] and "[SECRET] inside it." in secrets[9004]["text"]
        assert secrets[9004]["n_chars"] == len(secrets[9004]["text"])
    sizes = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(sizes) == set(secrets)
    assert sum(r["length"] for r in pieces) == sum(sizes.values())


def test_columns_of_any_name_keep_their_values(spark, sf):
    texts = ["a text of its own that stays " * 9, f"another one with {KEY} in it " * 3, None]
    docs = spark.createDataFrame(
        [(i, t, "en", *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in CLASHES] == [f"{c}{r['doc_id']}" for c in CLASHES], name


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert sorted(out.columns) == ["doc_id", "doc_tokens", "ids", "ids_crc32", "length", "offset", "sequence_id", "start"]
    rows = out.collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    # a user has whole sequences, and in a document's pieces all of its tokens
    filled = {}
    for r in rows:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 2048 for s, n in filled.items() if s != max(filled))


def test_empty_tables(spark, sf, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "test")
    assert docs.collect() == []
