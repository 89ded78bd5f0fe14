"""The manifest against a plain tree, its proofs, and odd rows."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from eventlens.llm.merkle import fold_proof, leaf_digest, merkle_manifest, verify_manifest
from eventlens.llm.order import numbered
from eventlens.llm.queries import ORACLES, QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """The top, and for each digest the list of (place, siblings) up to it."""
    if len(digests) == 1:
        return digests[0], [[]]
    runs = [digests[i:i + fanout] for i in range(0, len(digests), fanout)]
    top, above = plain_tree([sha("".join(r)) for r in runs], fanout)
    return top, [
        [(i % fanout, [d for j, d in enumerate(runs[i // fanout]) if j != i % fanout]), *above[i // fanout]] for i in range(len(digests))
    ]


def plain_manifest(rows, fanout):
    groups = {}
    for group, doc_id, digest in rows:
        groups.setdefault((group is not None, group or ""), []).append((doc_id is not None, doc_id or 0, digest))
    order = sorted(groups, key=lambda k: (k[0], k[1].encode()))
    tops = {k: plain_tree([d for _, _, d in sorted(groups[k])], fanout) for k in order}
    root, upper = plain_tree([tops[k][0] for k in order], fanout)
    return [
        (k[1] if k[0] else None, i if has else None, d, tops[k][0], root, proof + upper[n])
        for n, k in enumerate(order) for (has, i, d), proof in zip(sorted(groups[k]), tops[k][1], strict=True)
    ]


@pytest.mark.parametrize("fanout,levels,groups", [(2, 3, 3), (3, 2, 5), (4, 1, 2)])
def test_against_a_plain_tree(spark, fanout, levels, groups):
    sizes = [1, 2, 37, 5, 64, 17, 3][:groups]
    rows = [(n * 1000 + i, f"g{n}" if n else None, f"text {i % 11}") for n, size in enumerate(sizes) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = merkle_manifest(docs, ["doc_id", "lang", "text"], fanout=fanout, levels=levels)
    want = plain_manifest([(g, i, plain_leaf((i, g, t))) for i, g, t in rows], fanout)
    found = sorted(
        ((r["group"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["place"], s["others"]) for s in r["proof"]]) for r in got.collect()),
        key=str)
    assert found == sorted(want, key=str)
    assert got.select(fold_proof(F.col("leaf"), F.col("proof")).alias("r"), "root").filter("r <> root").isEmpty()


def test_odd_rows(spark, odd_docs, no_docs):
    """Null, empty, repeated and long rows; columns whose names are those of results."""
    docs = odd_docs.withColumnRenamed("keep_id", "proof").withColumn("position", F.lit("x"))
    got = [r for r in verify_manifest(merkle_manifest(docs, ["doc_id", "text", "proof"], group_col="proof")).collect()]
    rows = [(r["proof"], r["doc_id"], plain_leaf((r["doc_id"], r["text"], r["proof"]))) for r in docs.collect()]
    want = plain_manifest(rows, 2)
    assert sorted((str(r["group"]), str(r["doc_id"]), r["leaf"], r["root"]) for r in got) == sorted(
        (str(w[0]), str(w[1]), w[2], w[4]) for w in want)
    assert all(r["verified"] for r in got) and {r["group"] for r in got} == {None, "en"}
    assert merkle_manifest(no_docs, FIELDS).collect() == []
    one = merkle_manifest(docs.limit(1), ["doc_id"], group_col="proof").first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


def test_a_changed_field_is_found(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("de").alias("lang"), F.lit("x").alias("text"))
    claim = F.when(F.col("doc_id") == 7, leaf_digest(F.col("doc_id"), F.lit("y")))
    got = verify_manifest(merkle_manifest(docs, ["doc_id", "text"], claim=claim))
    assert [r["doc_id"] for r in got.filter("not verified").collect()] == [7]


def test_query_against_sql_with_nulls(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", None if i % 4 == 0 else ["de", "é", "", "en"][i % 4], None if i % 7 == 3 else i, t)
            for i in range(130) for t in ([None, "", "Größe", "x" * 300][i % 4],)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    checked = con.sql(ORACLES["op13_merkle_manifest"])
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    names = [c[0] for c in checked.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(checked.fetchall())
    changed = {i for i, _, _, n, _ in rows if n is not None and zlib.crc32(str(i).encode()) % 7 == 0}
    assert changed and {r["doc_id"] for r in got.filter("not verified").collect()} == changed


def test_numbered_spreads_a_hot_group_and_ties(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 != 0, "hot").alias("g"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("v"))
    got = numbered(rows, ["g"], [F.col("v")]).collect()
    for g in (None, "hot"):
        part = sorted((r["position"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in part] == list(range(len(part)))
        assert [v for _, v in part] == sorted(v for _, v in part)
