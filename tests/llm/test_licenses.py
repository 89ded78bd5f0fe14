"""License passages and phrases against a plain scan."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from eventlens.llm.licenses import NOTICES, TEMPLATES, Template, labels_of, scan_licenses, words_of
from eventlens.llm.queries import QUERIES
from tests.llm import plain


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.ascii_lower(text or ""))


def plain_places(text):
    words = plain_words(text)
    out = []
    for phrase in ("mit license", "apache license", "general public license"):
        want = phrase.split()
        out += [(i, i + len(want), phrase) for i in range(len(words)) if words[i:i + len(want)] == want]
    return sorted(out)


ODD = [
    None, "", "...", "MIT License", "mit  LICENSE, mit license.", "mit-license/apache_license", "the GNU General Public License general public license",
    "mit", "license mit", "mıt license", "MIT\nLICENSE", "general public", "generalpublic license", "mit license " * 3000, "é" * 5000,
]


def test_base_places(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "no license"), (None, "apache license"), (3, ODD[4])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, key int")
    got = sorted(
        ((r["doc_id"], r["n_words"], [(s["start"], s["end"], TEMPLATES[s["template"]].text) for s in r["spans"] if TEMPLATES[s["template"]].base])
         for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted(((i, len(plain_words(t)), plain_places(t)) for i, t in rows), key=str)


def test_edited_texts_are_found_and_others_are_not(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for n, t in enumerate(NOTICES):
        words = words_of(t.text)
        if len(words) < 25:
            continue
        edited = [w for i, w in enumerate(words) if i % 19 != 7]
        edited.insert(len(edited) // 2, "an added word")
        rows.append((n, f"{filler(40)} {' '.join(edited)} {filler(30)}"))
        want[n] = t.label
        # a third of the text, and the words in another order
        rows.append((100 + n, f"{filler(40)} {' '.join(words[:len(words) // 3])} {filler(30)}"))
        rows.append((200 + n, " ".join(rng.sample(words, len(words)))))
    assert len(want) >= 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_licenses(docs).collect()}
    whole = {i: {NOTICES[s["template"] - 3].label for s in r["spans"] if s["template"] >= 3 and s["end"] - s["start"] > 20} for i, r in got.items()}
    assert {i: s for i, s in whole.items() if s} == {i: {label} for i, label in want.items()}
    for i in want:
        spans = [s for s in got[i]["spans"] if s["end"] - s["start"] > 20]
        assert len(spans) == 1 and 38 <= spans[0]["start"] <= 48 and 0.6 <= spans[0]["coverage"] <= 1
    assert scan_licenses(docs, []).filter("size(spans) > 0").isEmpty()


def test_two_passages_side_by_side(spark):
    text = "one two three four five six seven eight nine ten"
    templates = [Template("x", text)]
    docs = spark.createDataFrame([(1, f"{text} {text} between {text}"), (2, text[:20])], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["coverage"]) for s in r["spans"]] for r in scan_licenses(docs, templates).collect()}
    assert got == {1: [(0, 10, 1.0), (10, 20, 1.0), (21, 31, 1.0)], 2: []}


@pytest.mark.parametrize("texts", [[], [None]])
def test_query_on_tables_without_text(spark, no_docs, texts, tmp_path):
    docs = no_docs if not texts else spark.createDataFrame([(1, None, "en", "s", 0)], no_docs.schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op12_license_scan"](spark, str(tmp_path)).collect()]
    assert got == [(1, 0, 0, None, None, "", "", 0.0)][:len(texts)]


def test_labels_are_sorted(spark):
    spans = F.array(*[F.struct(F.lit(n).alias("template")) for n in (2, 0, 2, 1)])
    assert spark.range(1).select(labels_of(spans, TEMPLATES)).first()[0] == "apache,gpl,mit"
