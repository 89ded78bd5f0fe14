"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.session import settle


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of ``links`` (columns ``a, b``, longs).

    Each round gives a node the smallest label among its neighbours and then the
    label of its label, so paths shorten by half or better. Labels are written
    to the shared folder after each round; nothing but the question whether any
    label changed reaches the driver. Links are joined on their end points,
    whose degree the callers bound; the join on a label, which a large component
    shares, has one row per label on its other side, so AQE can split it.

    Rounds go on until no label changes; labels only fall, so they end. Repeated
    links, links from a node to itself and an empty table are allowed. Returns ``node, label``.
    """
    both = settle(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links",
    )
    labels = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        moved = settle(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")),
            "moved",
        )
        hop = moved.select("label").distinct().join(
            moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label",
        )
        labels = settle(
            moved.join(hop, "label").select("node", F.least("label", "to").alias("label"), "old"), "labels",
        )
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
