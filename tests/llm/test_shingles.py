"""Near copies by five-word shingles against all pairs, and as a stage of the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from eventlens.llm import shingles as near_copies
from eventlens.llm.shingles import shingle_dedup
from tests.llm import plain


def shingles(text):
    words = plain.ascii_lower(text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def near(a, b):
    return len(a & b) / len(a | b) >= 0.8


def edited(words, places, rng):
    return " ".join(f"new{rng.random()}" if i in places else w for i, w in enumerate(words))


def test_ordinary_near_copies_leave_the_pipeline(spark, sf):
    """Three words of 300 changed: far more than two bits of a fingerprint, more than 0.8 of the shingles."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [edited(words, {20 + 9 * k, 120 + 9 * k, 220 + 9 * k}, rng) if k else " ".join(words) for k in range(6)]
    bits = [plain.fingerprint(t) for t in texts]
    assert max((bits[0] ^ b).bit_count() for b in bits) > 2
    docs = spark.createDataFrame([*enumerate(texts), (9, "another text of its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == [0, 9]


def test_against_all_pairs(spark, odd_docs):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for group in range(12):
        words = [f"g{rng.randrange(900)}" for _ in range(rng.choice([30, 120, 400]))]
        for k in range(6):
            many = rng.choice([0, 1, 2, 4, 9])
            places = set(rng.sample(range(len(words)), many))
            # a common passage puts texts that are no near copies in the same buckets
            rows.append((100 + 10 * group + k, edited(words, places, rng)))
    base = [f"c{i}" for i in range(100)]
    rows += [(400 + k, " ".join(base + [f"own{k}x{i}" for i in range(30)])) for k in range(12)]
    rows += [(420 + k, " ".join(base[k * 4:] + [f"t{i}" for i in range(4 * k)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(i, shingles(t)) for i, t in rows if i is not None]
    want = plain.components(range(len(kept)), lambda a, b: near(kept[a][1], kept[b][1]))
    least: dict = {}
    for place, root in want.items():
        least[root] = min(least.get(root, 1 << 60), kept[place][0])
    assert plain.rows_of(shingle_dedup(docs), "doc_id", "component_id") == sorted(
        ((kept[p][0], least[root]) for p, root in want.items()), key=str)


def test_no_rows(spark, no_docs):
    assert shingle_dedup(no_docs).collect() == []


def test_simhash_finds_candidates_by_itself(spark, monkeypatch):
    """Without a MinHash bucket in common, texts within two bits are joined if they share enough, and only then."""
    monkeypatch.setattr(near_copies, "buckets", lambda found: np.full(near_copies.TABLES, found.sum(dtype=np.uint64).view(np.int64)))
    words = [f"w{i}x{i % 89}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words, "tail"]), "another text of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert plain.rows_of(shingle_dedup(docs), "doc_id", "component_id") == [(0, 0), (1, 0), (2, 2)]
    monkeypatch.setattr(near_copies, "NEAR", (10001, 10002))
    assert plain.rows_of(shingle_dedup(docs), "doc_id", "component_id") == [(0, 0), (1, 1), (2, 2)]
