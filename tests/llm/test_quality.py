"""The classifier on held-out labels, its tables, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from eventlens.llm.quality import FEATURES, features, fit, keep_quality, score_quality, shallow_tree, train
from eventlens.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """On the fifth that never teaches, of the middle tables."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = QUERIES["op1_quality"](spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad = [p for p, q in held if q == 0]
    good = [p for p, q in held if q == 1]
    assert sum(p == 0 for p in bad) / len(bad) > 0.95
    assert sum(p == 1 for p in good) / len(good) > 0.99


def test_pairs_learn_what_single_features_cannot():
    random = np.random.default_rng(1)
    rows = random.random((4000, len(FEATURES)))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    alone, both = fit(rows, labels, n_pairs=0), fit(rows, labels)
    right = lambda m: ((m.scores(rows) > 0.5) == labels).mean()
    assert right(alone) < 0.75 < 0.9 < right(both)
    assert (0, 1) in both.pairs


def test_shallow_tree_finds_the_steps():
    g = np.array([1.0, 1, 1, -2, -2, 3, 3])
    assert shallow_tree(g, np.ones(7), 0.0, 0.5).tolist() == [1, 1, 1, -2, -2, 3, 3]
    assert shallow_tree(np.zeros(1), np.ones(1), 1.0, 1.0).tolist() == [0]


def test_models_without_rows_or_contrast():
    none = fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    ones = fit(np.ones((5, len(FEATURES))), np.ones(5))
    assert none.scores(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    assert ones.scores(np.zeros((1, len(FEATURES))))[0] == pytest.approx(6 / 7)


def test_features_are_finite_on_odd_texts():
    found = features(pa.array([None, b"", b" \n", b"A", b"x" * 10**6, "é😀".encode(), b"\xff\xfe"], pa.binary()))
    assert np.isfinite(found).all() and (found[0] == found[1]).all()


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = train(odd_docs, labels)
    rows = score_quality(odd_docs.withColumnRenamed("n_lines", "score"), model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    empty = {r["score"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(empty) == 1
    assert keep_quality(odd_docs, model, 0.0).count() == odd_docs.count()
    assert keep_quality(odd_docs, model).columns == odd_docs.columns
    nothing = train(no_docs, labels.limit(0))
    assert score_quality(no_docs, nothing).collect() == []


def test_sample_is_bounded(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr("eventlens.llm.quality.fit", lambda rows, labels, **_: seen.append(len(rows)))
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    train(docs, labels, max_rows=20)
    assert seen == [20]


def test_sample_is_bounded_where_ids_repeat(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr("eventlens.llm.quality.fit", lambda rows, labels, **_: seen.append(len(rows)))
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    again = docs
    for _ in range(4):
        again = again.union(docs)
    train(again, labels.union(labels), max_rows=20)
    assert seen == [20]


def plain_logit(model, row):
    """Row by row: one looked-up value per feature and per pair."""
    at = lambda edges, x: sum(e <= x for e in edges)
    total = model.intercept + sum(model.tables[f][at(model.edges[f], row[f])] for f in range(len(row)))
    return total + sum(table[at(model.coarse[f], row[f]), at(model.coarse[k], row[k])] for (f, k), table in model.pairs.items())


def test_scores_are_sums_of_table_values(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = train(docs, labels, rounds=20, pair_rounds=10)
    assert model.pairs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score_quality(docs, model).collect():
        row = features(pa.array([texts[r["doc_id"]].encode()], pa.binary()))[0]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-plain_logit(model, row))), abs=1e-9)


def test_boosting_against_a_plain_loop():
    """Every tree of up to three leaves is searched over all cuts, on the rows themselves."""
    random = np.random.default_rng(3)
    rows = np.round(random.random((120, len(FEATURES))), 1)
    labels = (rows[:, 0] + rows[:, 1] + 0.3 * random.random(120) > 1.1).astype(float)
    model = fit(rows, labels, rounds=3, n_pairs=0, ridge=1.0, rate=0.1, least=1.0)
    logits = [model.intercept] * len(rows)
    for _ in range(3):
        for f in range(len(FEATURES)):
            bins = [sum(e <= x for e in model.edges[f]) for x in rows[:, f]]
            p = [1 / (1 + np.exp(-z)) for z in logits]
            g = np.bincount(bins, [y - q for y, q in zip(labels, p)], len(model.edges[f]) + 1)
            h = np.bincount(bins, [max(q * (1 - q), 1e-9) for q in p], len(model.edges[f]) + 1)
            step = shallow_tree(g, h, 1.0, 1.0)
            logits = [z + 0.1 * step[b] for z, b in zip(logits, bins)]
    assert model.scores(rows) == pytest.approx([1 / (1 + np.exp(-z)) for z in logits], abs=1e-9)
