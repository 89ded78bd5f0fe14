"""A trie of conversation prefixes: what conversations share from their first turn on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.llm.common import in_batches
from eventlens.llm.order import numbered
from eventlens.llm.trees import subtree_totals
from eventlens.session import settle

# Turns of a conversation, and numbers of conversations, that are handled as one list.
CHUNK = 1 << 12


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, n_chars`` of each turn: its place from 0, SHA-256 of role and text, code points.

    Order is by turn, then role and text; a null turn comes first. A null role or
    text is empty. Repeated rows are turns of their own. Rows without ``conv_id``
    belong to no conversation and are left out, and other columns are ignored.
    Turns are put in order by ranges, so a conversation of any length is spread.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"),
    )
    placed = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return placed.select(
        "conv_id", "position", F.unhex(F.sha2(said, 256)).alias("digest"), F.length("text").cast("long").alias("n_chars"),
    )


def _prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``node`` and ``parent``, names of the sequences up to each turn and up to the one before.

    A sequence is named by exclusive-or over hashes of its turns, each hashed
    together with its place, twice 64 bits. So a name is a running sum, which
    chunks of a conversation can make apart: their totals, a row per CHUNK turns,
    give what stands before a chunk.
    """
    parts = {"a": 1, "b": 2}
    # a row's hash depends on all of its digest under two different seeds
    hashed = turns.withColumns({f"h_{c}": F.xxhash64(F.lit(seed), "position", "digest") for c, seed in parts.items()})
    keyed = settle(hashed.withColumn("chunk", F.expr(f"position div {CHUNK}")), "hashed")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"h_{c}").alias(f"t_{c}") for c in parts])
    bases = totals.select("conv_id", "chunk", *[F.bit_xor(f"t_{c}").over(before).alias(f"base_{c}") for c in parts]).filter("chunk > 0")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = keyed.withColumns({f"x_{c}": F.bit_xor(f"h_{c}").over(inside) for c in parts})
    first = run.filter("chunk = 0").withColumns({f"base_{c}": F.lit(0).cast("long") for c in parts})
    later = run.filter("chunk > 0").join(bases, ["conv_id", "chunk"])
    node = {c: F.col(f"x_{c}").bitwiseXOR(F.col(f"base_{c}")) for c in parts}
    up = {c: node[c].bitwiseXOR(F.col(f"h_{c}")) for c in parts}
    return first.unionByName(later).select(
        "conv_id", (F.col("position") + 1).alias("depth"), "n_chars",
        F.struct(*[node[c].alias(c) for c in parts]).alias("node"), F.struct(*[up[c].alias(c) for c in parts]).alias("parent"),
    )


def _ends_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the ids ``conv_id`` of each node in rising order, comma-joined.

    Ids are listed in chunks of CHUNK consecutive numbers, so a list is bounded.
    A node with one chunk is hashed where it is; the chunks of others are streamed in
    order through a hash, which takes one node's chunks in one task but holds a
    batch and a state only. One SHA-256 over all ids of a node allows no other way.
    """
    chunks = settle(
        ends.groupBy("node", F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("chunk"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")),
        "ends",
    )
    counted = settle(chunks.groupBy("node").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("ids").alias("ids")), "chunked")
    short = counted.filter("n_chunks = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    long = chunks.join(counted.filter("n_chunks > 1").select("node"), "node", "left_semi").select(
        F.col("node.a").alias("a"), F.col("node.b").alias("b"), "chunk", "ids",
    ).repartition("a", "b").sortWithinPartitions("a", "b", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != name:
                    if state is not None:
                        done.append((*name, state.hexdigest()))
                    name, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _digests(done)
        if state is not None:
            yield _digests([(*name, state.hexdigest())])

    streamed = in_batches(long).mapInArrow(run, "a long, b long, ends_sha256 string")
    return short.unionByName(streamed.select(F.struct("a", "b").alias("node"), "ends_sha256"))


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = zip(("a", "b", "ends_sha256"), (pa.int64(), pa.int64(), pa.string()), strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], ["a", "b", "ends_sha256"],
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of conversations, the empty one included.

    ``turns`` has ``conv_id, position`` (from 0, without gaps), ``digest`` and
    ``n_chars``, as :func:`number_turns` gives them; ``convs`` has each ``conv_id``
    once and its number of turns ``n_turns``, 0 where it has none. Two prefixes are the same node when their
    digests are. Returns per node, as longs where nothing else is said:

    - ``conv_id``, the smallest conversation that begins with the prefix; ``depth``, its turns;
      ``parent_conv_id``, that of the prefix less its last turn (null at the root);
    - ``n_convs``, conversations that begin with it; ``n_children``, nodes one turn longer;
    - ``n_leaves``, nodes of its subtree without children (itself counts); ``saved_tokens``,
      over its subtree, ``n_chars`` of a node's last turn for each conversation but one;
    - ``ends_sha256`` (text), SHA-256 of the ids of the conversations that end here, rising, comma-joined.

    A turn many conversations share is counted before the shuffle. Totals over
    subtrees come from :func:`subtree_totals`. A null ``conv_id`` takes no part;
    without conversations there is no node, the root neither. Texts of any length travel as digests;
    columns beside those named are ignored.
    """
    convs = settle(convs.filter("conv_id IS NOT NULL").select("conv_id", "n_turns"), "convs")
    prefixes = settle(_prefixes(turns.select("conv_id", "position", "digest", "n_chars")), "prefixes")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_chars"),
        F.lit(None).cast("struct<a:long,b:long>").alias("parent"),
    )
    # all rows of a node agree on its length and parent
    inner = prefixes.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("parent").alias("parent"),
    )
    nodes = settle(root.unionByName(inner), "nodes")
    children = settle(
        nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children",
    )
    known = settle(
        nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "known",
    )
    weighed = known.select(
        "node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"])
    last = prefixes.join(
        convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"], "left_semi",
    ).select("node", "conv_id")
    ends = _ends_digests(last.union(convs.filter("n_turns = 0").select(zero, "conv_id")))
    names = settle(known.join(children.select("node"), "node", "left_semi").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "names")
    told = settle(known.join(totals, "node").join(ends, "node", "left"), "told")
    return told.join(names, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, shared: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first ``shared`` turns from the conversation ``base``: turns and convs for :func:`prefix_trie`.

    ``shared`` and ``base`` are columns of ``conv_id``, ``shared`` between 0 and a small
    bound, since every conversation reads that many turns of its base. A
    conversation keeps its own turns after the first ``shared``; a base with
    fewer turns gives all it has, an absent one none.
    """
    turns = settle(turns, "turns")
    own = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "own")
    asked = own.select("conv_id", "n_own", shared.cast("long").alias("shared"), base.alias("base"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("shared", F.coalesce("n_base", F.lit(0)))
    plan = settle(asked.join(sizes, "base", "left").withColumn("taken", taken), "plan")
    heads = plan.filter("taken > 0").select("conv_id", "base", F.posexplode(F.expr("sequence(1, taken)")).alias("position", "one"))
    given = turns.select(F.col("conv_id").alias("base"), F.col("position").cast("int").alias("position"), "digest", "n_chars")
    first = heads.join(given, ["base", "position"]).select("conv_id", F.col("position").cast("long").alias("position"), "digest", "n_chars")
    kept = turns.join(plan.select("conv_id", "shared", "taken"), "conv_id").filter("position >= shared").select(
        "conv_id", (F.col("position") - F.col("shared") + F.col("taken")).alias("position"), "digest", "n_chars",
    )
    convs = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("shared"), F.lit(0))).alias("n_turns"))
    return first.unionByName(kept), convs
