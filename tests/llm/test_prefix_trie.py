"""Subtree totals on trees of many shapes, and the trie against a plain dictionary."""

from __future__ import annotations

import hashlib
import random
import zlib

from pyspark.sql import functions as F

import eventlens.llm.prefix_trie as prefix_trie_module
from eventlens.llm.prefix_trie import number_turns, prefix_trie, rebuilt
from eventlens.llm.trees import subtree_totals


def shapes():
    rng = random.Random(2)
    chain = [(i, i - 1 if i else None) for i in range(60)]
    star = [(0, None), *[(i, 0) for i in range(1, 200)]]
    comb = [(0, None), *[(i, i - 1) for i in range(1, 30)], *[(100 + i, i) for i in range(30)]]
    bushy = [(0, None), *[(i, rng.randrange(i)) for i in range(1, 150)]]
    forest = [(i, None) for i in range(5)] + [(10 + i, i % 5) for i in range(20)]
    return {"chain": chain, "star": star, "comb": comb, "bushy": bushy, "forest": forest, "one": [(9, None)]}


def test_subtree_totals(spark):
    """All shapes as one forest, each moved to numbers of its own."""
    tree = [(1000 * k + n, None if p is None else 1000 * k + p) for k, shape in enumerate(shapes().values()) for n, p in shape]
    rows = [(n, p, n * n % 17, None if n % 5 == 0 else 1) for n, p in tree]
    got = {r["node"]: (r["w"], r["c"]) for r in subtree_totals(
        spark.createDataFrame(rows, "node long, parent long, w long, c int"), ["w", "c"]).collect()}
    want = {n: [w, c or 0] for n, _, w, c in rows}
    up = {n: p for n, p, _, _ in rows}
    for n, _, w, c in rows:
        above = up[n]
        while above is not None:
            want[above] = [want[above][0] + w, want[above][1] + (c or 0)]
            above = up[above]
    assert got == {n: tuple(v) for n, v in want.items()}
    assert subtree_totals(spark.createDataFrame([], "node long, parent long, w long"), ["w"]).collect() == []


def plain_trie(conversations):
    """``conversations`` maps ids to lists of (role, text)."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(path))))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(turns):
    own = {}
    for c, turn, role, text in sorted(
            (r for r in turns if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[:h[c]] + own[c][h[c]:] for c in own}


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(200, 260), 305, 701, 702, 1000000]:
        n = rng.choice([1, 2, 3, 6, 9])
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bb", "", "Größe 😀", None])))
    rows += [(5, None, None, "first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (None, 0, "user", "lost"), (6, 2, None, "x" * 9000)]
    return rows


def test_rebuilt_conversations(spark, monkeypatch):
    """With chunks of two, conversations and lists of ids are cut and put together."""
    monkeypatch.setattr(prefix_trie_module, "CHUNK", 2)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    conv = F.col("conv_id")
    turns, convs = rebuilt(number_turns(df), F.crc32(conv.cast("string")) % 6, conv - conv % 100)
    got = sorted((tuple(r) for r in prefix_trie(turns, convs).collect()), key=str)
    assert got == plain_trie(plain_rebuilt(rows))


def test_many_equal_conversations_and_none(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    numbered = number_turns(df)
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    got = sorted((tuple(r) for r in prefix_trie(numbered, convs).collect()), key=str)
    assert got == plain_trie({c: [("user", "t0"), ("user", "t1")] for c in range(300)})
    assert prefix_trie(numbered.limit(0), convs.limit(0)).collect() == []
    # conversations without a turn are at the root
    bare = prefix_trie(numbered.limit(0), convs.withColumn("n_turns", F.lit(0))).collect()
    assert [(r["n_convs"], r["n_leaves"], r["depth"]) for r in bare] == [(300, 1, 0)]
