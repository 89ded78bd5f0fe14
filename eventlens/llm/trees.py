"""Subtree totals of forests by parallel tree contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.session import settle


def _coin(node: Column, number: int) -> Column:
    """A fair coin of a node in a round, the same whenever it is asked."""
    return F.pmod(F.xxhash64(node, F.lit(number)), F.lit(2)) == 1


def _children(live: DataFrame, sums: list[str]) -> DataFrame:
    """Per node that has any: the number of its children, and one of them with what it passes on besides its total."""
    one = F.min(F.struct(F.col("node"), *[F.col(f"add_{c}") for c in sums])).alias("child")
    return live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), one)


def subtree_totals(tree: DataFrame, sums: list[str]) -> DataFrame:
    """``node`` and the totals of ``sums`` over the subtree of each node, itself included.

    ``tree`` has ``node``, ``parent`` (null at a root) and long columns ``sums``. A
    round first rakes: a leaf's total is final, and its parent takes it over.
    Then it compresses: of the nodes with a single child, those whose coin shows
    heads and whose child's shows tails are taken out, and the child passes their weight
    on to the parent above. No two neighbours go at once, so a chain loses about a quarter
    of its nodes a round and a bushy part its leaves; some logarithm of the
    number of nodes is enough for any shape. At the end rounds are gone back in reverse:
    a node taken out gets its total from that of the child it had.

    Nodes are joined by node on both sides, one row each, and a node's children
    are summed before the shuffle, so one with a third of all nodes as children costs no task more than
    others. Each round is written to the shared folder. Node may have any
    type that can be joined. Nodes are distinct, parents are nodes, and there are no cycles;
    an empty forest gives no rows. Null weights count as 0.
    """
    weights = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums]
    nothing = [F.lit(0).cast("long").alias(f"add_{c}") for c in sums]
    live = settle(tree.select("node", "parent", *weights, *nothing), "live")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        marked = settle(live.join(_children(live, sums).drop("child"), "node", "left"), "marked")
        leaves = marked.filter("n_children IS NULL").select("node", "parent", *sums, *[f"add_{c}" for c in sums])
        gifts = leaves.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(c) + F.col(f"add_{c}")).alias(f"gift_{c}") for c in sums],
        )
        rest = settle(
            marked.filter("n_children IS NOT NULL").join(gifts, "node", "left").select(
                "node", "parent", *[(F.col(c) + F.coalesce(f"gift_{c}", F.lit(0))).alias(c) for c in sums], *[f"add_{c}" for c in sums],
            ),
            "rest",
        )
        if rest.isEmpty():
            return _expanded(leaves.select("node", *sums), rounds, sums)
        number = len(rounds)
        single = (F.col("n_children") == 1) & F.col("parent").isNotNull()
        goes = single & _coin(F.col("node"), number) & ~_coin(F.col("child.node"), number)
        chained = settle(rest.join(_children(rest, sums), "node", "left").withColumn("goes", F.coalesce(goes, F.lit(False))), "chained")
        gone = chained.filter("goes")
        raised = gone.select(
            F.col("child.node").alias("node"), F.col("parent").alias("above"),
            *[(F.col(c) + F.col(f"add_{c}")).alias(f"more_{c}") for c in sums],
        )
        up = F.when(F.col("above").isNotNull(), F.col("above")).otherwise(F.col("parent")).alias("parent")
        live = settle(
            chained.filter("not goes").join(raised, "node", "left").select(
                "node", up, *sums, *[(F.col(f"add_{c}") + F.coalesce(f"more_{c}", F.lit(0))).alias(f"add_{c}") for c in sums],
            ),
            "live",
        )
        # what a node taken out has in all: its own, what its child passes on, and the child's total
        owed = gone.select("node", F.col("child.node").alias("child"), *[(F.col(c) + F.col(f"child.add_{c}")).alias(c) for c in sums])
        rounds.append((leaves.select("node", *sums), owed))


def _expanded(known: DataFrame, rounds: list[tuple[DataFrame, DataFrame]], sums: list[str]) -> DataFrame:
    """Totals of all nodes, from those that outlived the ``rounds`` back to the first round.

    A round's nodes look for their children among the nodes that outlived it,
    whose number falls from round to round, so all lookups together read a few times the nodes.
    """
    for leaves, owed in reversed(rounds):
        totals = known.select(F.col("node").alias("child"), *[F.col(c).alias(f"total_{c}") for c in sums])
        restored = settle(
            owed.join(totals, "child").select("node", *[(F.col(c) + F.col(f"total_{c}")).alias(c) for c in sums]), "restored",
        )
        known = reduce(DataFrame.union, [known, restored, leaves])
    return known
