"""Exact, line and SimHash deduplication against SQL and plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventlens.llm import line_dedup as lines
from eventlens.llm.components import components
from eventlens.llm.exact_dedup import exact_dedup, keep_one_copy
from eventlens.llm.queries import ORACLES, QUERIES
from eventlens.llm.simhash import covering_links, covering_masks, keep_one_near_copy, simhash_dedup
from tests.llm import plain
from tools.compare import canonical, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    result = QUERIES[name](spark, sf)
    checked = connect(sf).execute(ORACLES[name])
    columns = [c[0] for c in checked.description]
    assert sorted(columns) == sorted(result.columns)
    assert canonical(result.columns, [tuple(r) for r in result.collect()]) == canonical(columns, checked.fetchall())


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        body = "".join(c for c in text if c not in plain.SPACES)
        groups[body].append((doc_id is None, -len(text), doc_id))
    out = []
    for body, members in groups.items():
        keep = min(members)[2]
        digest = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[2], keep, len(members), m[2] == keep, digest) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_exact_dedup_on_odd_rows(spark, odd_docs, no_docs, slots):
    want = plain_exact([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    got = exact_dedup(odd_docs, hash_all=True, slots=slots).withColumn("text_hash", F.lower(F.hex("text_hash")))
    assert plain.rows_of(got, *got.columns) == want
    # without hash_all only shared texts are hashed, and groups are the same
    lean = {(r[0], r[1], r[2], r[3]): r[4] for r in exact_dedup(odd_docs).collect()}
    assert set(lean) == {w[:4] for w in want}
    assert all(h is not None for k, h in lean.items() if k[2] > 1)
    assert exact_dedup(no_docs).collect() == []
    assert keep_one_copy(no_docs).columns == no_docs.columns


def test_keep_one_copy_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, "ab", 8), (3, "c", 7), (None, "ab", 6)], "doc_id long, text string, kept int")
    assert plain.rows_of(keep_one_copy(docs), "doc_id", "kept") == [(1, 9), (3, 7), (None, 6)]


def plain_lines(rows):
    key = lambda line: plain.ascii_lower(line.strip(plain.SPACES))
    low = -(1 << 63)
    docs = [(low if i is None else i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for doc_id, parts in docs:
        for k in {key(p) for p in parts}:
            if len(k) >= 20:
                holders[k].append(doc_id)
    out = []
    for doc_id, parts in docs:
        kept = [p for p in parts if len(holders[key(p)]) < 3 or doc_id == max(holders[key(p)])]
        out.append((None if doc_id == low else doc_id, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup_in_any_number_of_batches(spark, odd_docs, no_docs, batches):
    shared = "A Line that many documents SHARE äÖ"
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(100 + i, f"own line number {i} of this text\n  {shared if i % 2 else shared.upper().replace('Ä', 'ä')}\nx") for i in range(12)]
    rows += [(None, shared), (None, shared + "\n" + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1))
    got = lines.line_dedup(docs, batches=batches)
    assert plain.rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == plain_lines(rows)
    assert lines.line_dedup(no_docs, batches=batches).collect() == []


def test_runs_stay_disjoint_and_few(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for number in range(5):
        rows = [(number, k, k) for k in range(number, number + 10)]
        batch = spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")
        unseen = {r["h1"] for r in runs.unseen(batch).collect()}
        assert unseen == set(range(number + 9 if number else 0, number + 10))
        runs.add(batch)
    first = runs._read("first")
    assert first.count() == first.select("h1").distinct().count() == 14
    assert sum(len(level) for level in runs.levels["first"]) <= 3
    counts = {r["h1"]: (r["n_docs"], r["max_doc"]) for r in runs.counts().collect()}
    assert counts == {k: (min(k + 1, 5, 14 - k), min(k, 4)) for k in range(14)}


def test_runs_are_never_shuffled_again(spark):
    runs = lines.LineRuns(spark, buckets=3)
    for number in range(3):
        rows = [(number, k, k) for k in range(5 * number, 5 * number + 10)]
        runs.add(spark.createDataFrame(rows, "doc_id long, h1 long, h2 long"))
    placed = runs._run(runs._paths("first")[0])
    for frame in (runs.unseen(placed), runs.counts()):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert runs.counts().agg(F.sum("n_docs"), F.count("h1")).first() == (30, 20)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13])
def test_look_up_by_halving(spark, size):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.struct(k * 2, k)).alias("marks"))
    asked = F.transform(F.sequence(F.lit(0), F.lit(2 * size + 3)), lambda k: F.struct(k, F.floor(k / 2).cast("int")))
    got = row.select(F.transform(asked, lambda key: lines._among(F.col("marks"), key)).alias("found")).first()["found"]
    assert got == [k in range(2, 2 * size + 1, 2) for k in range(2 * size + 4)]


def test_masks_cover_every_pair_of_bits():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_covering_links_against_all_pairs(spark):
    random.seed(5)
    values = set()
    for _ in range(40):
        base = random.getrandbits(64)
        values.add(base)
        for _ in range(random.randint(0, 12)):
            for _ in range(random.randint(1, 3)):
                base ^= 1 << random.randrange(64)
            values.add(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    links = covering_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    assert all(close(r["a"], r["b"]) for r in links.collect())
    got = {r["node"]: r["label"] for r in components(links).collect()}
    want = plain.components(signed, close)
    assert {v: got.get(v, v) for v in signed} == want


def test_components_of_paths_and_loops(spark):
    chain = [(i + 1, i) for i in range(200)] + [(500, 500), (1000, 900), (1000, 900), (900, 1000)]
    random.seed(1)
    random.shuffle(chain)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 1000: 900, 900: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_simhash(rows):
    prints = [(i, plain.fingerprint(t)) for i, t in rows]
    value = plain.components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[value[p]].append(i)
    return sorted(((i, f"{p:016x}", min(least[value[p]], default=None)) for i, p in prints), key=str)


def test_simhash_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = simhash_dedup(odd_docs).withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    assert plain.rows_of(got, "doc_id", "fingerprint", "component_id") == plain_simhash(rows)
    assert simhash_dedup(no_docs).collect() == []
    assert keep_one_near_copy(no_docs).columns == no_docs.columns


def test_simhash_query_against_plain(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_simhash_dedup"](spark, sf)
    assert plain.rows_of(got, "doc_id", "fingerprint", "component_id") == plain_simhash(rows)
