"""Secret scans against a walk over each text with Python's own expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from eventlens.llm.queries import QUERIES
from eventlens.llm.secrets import BASE, KINDS, redact_secrets, scan_secrets, span_list

KEY = "AKIA" + "Q7" * 8
TEXTS = [
    None, "", "nothing here", f"id {KEY} end", f"AKIAAKIA {KEY}x AKIA1234567890ABCDE",
    'PassWord = "abcdefghijkl" token:short secret=token: abcdefghijklmnop',
    "0123456789abcdef0123 0123456789abcde 😀 ffffffffffffffff",
    "api-key: AbCdEfGhIjKlMn apikey=ABCDEFGHIJKL. API_KEY : 'zzzzzzzzzzzz'",
    "user = bob password: hunter42 host=db.example.org", "password: hunter42 alone",
    "user = bob" + " filler" * 100 + " password: hunter42",
    "https://a.example/x user=bob pw secret='abcdefghijklm' " * 50,
    "token = " + "9a" * 20 + " tail password=hunter42 " + KEY,
]


def brute(text: str) -> list[tuple[int, int, int]]:
    found = []
    for kind, (pattern, group, least) in BASE.items():
        for match in re.finditer(pattern, text, re.ASCII):
            if len(match.group(group)) >= least:
                found.append((match.start(), KINDS.index(kind), match.end()))
    return sorted(found)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_and_links(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("base", F.lit(1))
    rows = {r["doc_id"]: r for r in scan_secrets(docs).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        base = [tuple(s) for s in rows[i]["base"]]
        spans = [tuple(s) for s in rows[i]["spans"]]
        assert base == brute(text or "")
        assert set(base) <= set(spans) and spans == sorted(spans)
    kinds = {i: [KINDS[s[1]] for s in rows[i]["spans"]] for i in rows}
    assert kinds[8] == ["weak_id", "weak_secret", "endpoint"]
    assert kinds[9] == [] and kinds[10] == []
    assert kinds[12][-2:] == ["weak_secret", "access"]


def test_query_over_the_table(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op8_secret_scan"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        want = brute(doc["text"] or "")
        row = got[doc["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [sum(KINDS[s[1]] == k for s in want) for k in BASE]


def test_odd_rows(spark, odd_docs, no_docs):
    assert scan_secrets(odd_docs).count() == odd_docs.count()
    assert scan_secrets(no_docs).collect() == []
    same = spark.createDataFrame([(1, f"a {KEY}"), (1, f"a {KEY}"), (1, "user=bob pwd: hunter42"), (None, f"{KEY}")],
                                 "doc_id long, text string")
    lists = sorted(r[0] for r in scan_secrets(same).select(span_list(F.col("spans"))).collect())
    assert lists == sorted([f"access:2:{2 + len(KEY)}"] * 2 + ["weak_id:0:8,weak_secret:9:22", f"access:0:{len(KEY)}"])


def test_redaction_keeps_the_rest(spark, no_docs):
    rows = [(1, f"é {KEY} tail", "en", None), (2, "clean", "de", 5), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = sorted(map(tuple, redact_secrets(docs).collect()), key=str)
    assert got == sorted([(1, "é [SECRET] tail", "en", 15), (2, "clean", "de", 5), (None, None, None, None)], key=str)
    assert redact_secrets(no_docs).columns == no_docs.columns


def test_blocks_are_scopes(spark):
    """Parts 500 characters apart are linked within a block of lines, and not beyond a blank line."""
    pad = "\n".join("# a line of comment" for _ in range(30))
    assert len(pad) > 500
    block = f"user = alice\n{pad}\npassword = short1"
    rows = [(1, block), (2, block.replace(pad, f"{pad}\n \t\n")), (3, f"intro\n\n{block}\n\nhost=db.example\n{pad}"), (4, f"{block}\nhost=db.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r["doc_id"]: [KINDS[s["kind"]] for s in r["spans"]] for r in scan_secrets(docs).collect()}
    assert kinds == {1: ["weak_id", "weak_secret"], 2: [], 3: ["weak_id", "weak_secret"], 4: ["weak_id", "weak_secret", "endpoint"]}
    assert redact_secrets(docs).filter("doc_id = 1").first()["text"] == f"[SECRET]\n{pad}\n[SECRET]"
