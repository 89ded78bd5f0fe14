"""A Merkle manifest of a dataset, its proofs gathered by butterfly exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.order import numbered
from eventlens.session import broadcast_within, settle

FANOUT = 2
# Levels of a tree folded within one block of FANOUT ** LEVELS leaves.
LEVELS = 9

_STEP = "struct<place:int,others:array<string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(f.cast("string")) for f in fields]), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of its ``proof`` give, from the leaf upwards."""

    def up(digest: Column, step: Column) -> Column:
        others, place = step["others"], step["place"]
        return _joined(F.concat(F.slice(others, 1, place), F.array(digest), F.slice(others, place + 1, F.size(others) + 1)))

    return F.aggregate(proof, leaf, up)


def proof_digests(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one array."""
    return F.flatten(F.transform(proof, lambda s: s["others"]))


def _powers(fanout: int) -> list[int]:
    """1, fanout, its square and so on, as far as longs reach."""
    found = [1]
    while found[-1] * fanout < 1 << 62:
        found.append(found[-1] * fanout)
    return found


def _depth(n: Column, fanout: int) -> Column:
    """Levels above ``n`` leaves: runs of ``fanout`` become one until one node remains."""
    return F.size(F.filter(F.array(*map(F.lit, _powers(fanout))), lambda p: p < n))


def _steps(depth: Column) -> Column:
    """0 to depth - 1, which ``sequence`` alone does not give for a depth of 0."""
    return F.slice(F.sequence(F.lit(0), depth), 1, depth)


def _layers(leaves: Column, depth: Column, fanout: int) -> Column:
    """``leaves`` and the layers above them, each a list of digests."""

    def above(layers: Column, _: Column) -> Column:
        last = F.element_at(layers, -1)
        runs = _steps(F.ceil(F.size(last) / F.lit(fanout)).cast("int"))
        return F.concat(layers, F.array(F.transform(runs, lambda i: _joined(F.slice(last, i * fanout + 1, fanout)))))

    return F.aggregate(_steps(depth), F.array(leaves), above)


def _step(run: Column, place: Column) -> Column:
    """The step of a proof for the digest at ``place`` of its run."""
    others = F.concat(F.slice(run, 1, place), F.slice(run, place + 2, F.size(run)))
    return F.struct(place.cast("int").alias("place"), others.alias("others")).cast(_STEP)


def _exchange(blocks: DataFrame, fanout: int) -> DataFrame:
    """Upper proofs of blocks: ``key, block, upper, top`` from ``key, block, n_blocks, digest``.

    Blocks of a key are the leaves of a tree. In round r the blocks whose numbers
    differ in digit r alone form a group; they swap the roots of the subtrees
    they stand for, and each hashes the parent for itself and notes its
    siblings. After the last round every block holds its whole upper proof and
    the top, and nothing has to be handed down. Numbers are filled up to a power
    of ``fanout`` with empty blocks that learn roots but add none, so each group
    has ``fanout`` rows at most and no block serves more than one group.
    """
    depth = _depth(F.col("n_blocks"), fanout)
    power = F.array(*map(F.lit, _powers(fanout)))
    filled = F.expr(f"explode(transform(sequence(1, {fanout - 1}), j -> block + j * n_blocks))")
    real = blocks.select("key", "block", "n_blocks", "digest")
    empty = real.select("key", filled.alias("block"), "n_blocks", F.lit(None).cast("string").alias("digest")).filter(
        F.col("block") < F.element_at(power, depth + 1),
    )
    state = settle(
        real.unionByName(empty).select("*", depth.alias("depth"), F.array().cast(f"array<{_STEP}>").alias("upper")), "round0",
    )
    rounds = state.agg(F.max("depth")).first()[0] or 0
    for number in range(rounds):
        width = fanout ** number
        active = F.col("depth") > number
        digit = F.when(active, F.expr(f"block div {width} % {fanout}")).otherwise(F.lit(0))
        groups = state.withColumn("digit", digit.cast("int")).groupBy(
            "key", "n_blocks", "depth", (F.col("block") - F.col("digit") * width).alias("first"),
        ).agg(F.sort_array(F.collect_list(F.struct("digit", "block", "digest", "upper"))).alias("mates"))
        run = F.transform(F.filter("mates", lambda m: m["digest"].isNotNull()), lambda m: m["digest"])
        met = groups.select("*", run.alias("run"), F.explode("mates").alias("m"))
        noted = active & F.col("m.digest").isNotNull()
        state = settle(
            met.select(
                "key", F.col("m.block").alias("block"), "n_blocks", "depth",
                F.when(active & (F.size("run") > 0), _joined(F.col("run"))).otherwise(F.col("m.digest")).alias("digest"),
                F.when(noted, F.concat("m.upper", F.array(_step(F.col("run"), F.col("m.digit"))))).otherwise(F.col("m.upper"))
                .alias("upper"),
            ),
            f"round{number + 1}",
        )
    return state.filter("block < n_blocks").select("key", "block", "upper", F.col("digest").alias("top"))


def _proofs(nodes: DataFrame, payload: list[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """``key, position, digest``, the columns ``payload``, ``proof`` and ``top`` of each node, and ``key, top`` of each tree."""
    size = fanout ** levels
    counts = broadcast_within(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    members = F.sort_array(F.collect_list(F.struct("position", "digest", *payload))).alias("members")
    depth = F.least(_depth(F.col("n"), fanout), F.lit(levels))
    leaves = F.transform("members", lambda m: m["digest"])
    blocks = settle(
        nodes.groupBy("key", F.expr(f"position div {size}").alias("block")).agg(members).join(counts, "key")
        .select("key", "block", "members", depth.alias("low"), F.ceil(F.col("n") / F.lit(size)).alias("n_blocks"),
                _layers(leaves, depth, fanout).alias("layers"))
        .select("key", "block", "members", "low", "n_blocks", F.element_at(F.element_at("layers", -1), 1).alias("digest")),
        "blocks",
    )
    upper = _exchange(blocks, fanout)
    power = F.array(*map(F.lit, _powers(fanout)))

    def local(place: Column) -> Column:
        def at(level: Column) -> Column:
            index = F.floor(place / F.element_at(power, level + 1)).cast("int")
            start = index - index % fanout
            return _step(F.slice(F.element_at("layers", level + 1), start + 1, fanout), index % fanout)

        return F.transform(_steps(F.col("low")), at)

    whole = blocks.join(upper, ["key", "block"]).withColumn("layers", _layers(leaves, F.col("low"), fanout))
    proved = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(local(i), F.col("upper")).alias("proof")))
    out = whole.select("key", "top", F.explode(proved).alias("p"))
    fields = ["position", "digest", *payload]
    rows = out.select("key", "top", *[F.col(f"p.m.{c}").alias(c) for c in fields], F.col("p.proof").alias("proof"))
    return rows, upper.filter("block = 0").select("key", "top")


def merkle_manifest(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", claim: Column | None = None,
    fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """Leaf, proof and roots of every row: ``doc_id, group, position, leaf, claim, proof, subroot, root``.

    The leaf of a row is :func:`leaf_digest` of ``fields``; ``claim`` is a further
    column computed beside it, such as the leaf of what a copy holds now. The
    rows of a group stand in the order of their ids, and every ``fanout``
    consecutive nodes become the digest of their digests' hexadecimal text until
    one remains, the subroot (the last run may be shorter, even one node, which
    is hashed alone). Subroots in the order of their groups give the root in the
    same way. ``proof`` lists, from the leaf to the root, the place in its run and
    the run's other digests; :func:`fold_proof` gives the root back.

    Texts are read once and never shuffled. Blocks of ``fanout ** levels`` rows
    are folded as lists, and blocks get their upper proofs by :func:`_exchange`,
    so neither a group nor a level comes to one task.

    A null group is a group of its own and the first; null ids come first in
    theirs, and rows of one id stand in the order of their leaves. Repeated rows
    are leaves each. Null and empty fields differ. Without rows there is no
    root and no row. Other columns are ignored and may have any name.
    """
    claimed = F.lit(None).cast("string") if claim is None else claim
    # a prefix keeps the order of groups and sets null, the empty key, before all others
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(
        key.alias("key"), F.col(id_col).cast("long").alias("doc_id"),
        leaf_digest(*[F.col(f) for f in fields]).alias("digest"), claimed.alias("claim"),
    )
    placed = numbered(rows, ["key"], [F.col("doc_id").asc_nulls_first(), F.col("digest")])
    low, subroots = _proofs(placed, ["doc_id", "claim"], fanout, levels)
    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("group_key"), F.col("top").alias("digest"))
    high = _proofs(numbered(groups, ["key"], [F.col("group_key")]), ["group_key"], fanout, levels)[0].select(
        F.col("group_key").alias("key"), F.col("proof").alias("high_proof"), F.col("top").alias("root"),
    )
    return low.join(broadcast_within(high), "key").select(
        "doc_id", F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("group"), "position",
        F.col("digest").alias("leaf"), "claim", F.concat("proof", "high_proof").alias("proof"),
        F.col("top").alias("subroot"), "root",
    )


def verify_manifest(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``folded_root``, that of the claim (of the leaf where there is none), and ``verified``."""
    folded = fold_proof(F.coalesce("claim", "leaf"), F.col("proof"))
    return manifest.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
