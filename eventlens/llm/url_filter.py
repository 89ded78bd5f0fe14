"""URL filters: host and path rules, then trust and distrust over the link graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import UPPER
from eventlens.session import settle

Rule = tuple[str, str, str]  # verdict, host, path

# An address in a link or source attribute, scheme present or inherited.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_text(rule: Rule) -> str:
    return rule[1] + rule[2]


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, or null.

    Longest first, each rule is one comparison of the row's own columns.
    """
    found = None
    for rule in sorted(rules, key=lambda r: (-len(rule_text(r)), rule_text(r))):
        verdict, rule_host, rule_path = rule
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        result = F.struct(F.lit(rule_text(rule)).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, result) if found is None else found.when(fits, result)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target, links``: links between different hosts, counted before the shuffle."""
    addresses = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    return (
        pages.select(host_of(F.col(url_col)).alias("source"), F.explode(addresses).alias("target"))
        .withColumn("target", F.translate("target", UPPER, UPPER.lower()))
        .filter("source <> '' AND target <> '' AND source <> target")
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))
    )


# Scores are final when four more rounds change none by a larger share of itself.
TOLERANCE = 1e-9


def propagate(
    edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Personalised PageRank for several kinds of seeds at once.

    ``edges`` has ``kind, a, b, links``; ``seeds`` has ``kind, host, seed``, the
    seeds of a kind adding up to one. A host hands ``damping`` of its score to
    the hosts it points at, by number of links; the rest comes from the seeds.
    Score that arrives at a host without edges goes no further, so the scores of
    a kind add up to one at most. Contributions are summed before their shuffle;
    every fourth round is stored, which keeps plans short and recovery cheap.

    Rounds go on until no score has changed by more than ``tolerance`` of itself
    since the round stored before; that one number reaches the driver. A host
    reached for the first time has changed by all of its score, so walks of any
    length are followed to their end. With ``rounds`` there are just so many.
    """
    out = edges.groupBy("kind", "a").agg(F.sum("links").alias("total"))
    steps = settle(
        edges.join(out, ["kind", "a"]).select("kind", "a", "b", (F.lit(damping) * F.col("links") / F.col("total")).alias("weight")),
        "steps",
    )
    restart = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    scores = stored = restart
    for number in count() if rounds is None else range(rounds):
        moved = steps.join(scores.withColumnRenamed("host", "a"), ["kind", "a"]).select(
            "kind", F.col("b").alias("host"), (F.col("weight") * F.col("score")).alias("score"),
        )
        scores = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if number % 4 == 3:
            scores = settle(scores, "scores")
            if rounds is None and _change(stored, scores) <= tolerance:
                break
            stored = scores
    return scores


def _change(before: DataFrame, after: DataFrame) -> float:
    """Largest change of a score, as a share of it; hosts come in and never go."""
    zero = F.lit(0.0)
    both = after.select("kind", "host", "score", zero.alias("old")).union(
        before.select("kind", "host", zero.alias("score"), F.col("score").alias("old")))
    summed = both.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
    share = F.try_divide(F.abs(F.col("score") - F.col("old")), F.col("score"))
    return summed.agg(F.max(share)).first()[0] or 0.0


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rounds: int | None = None,
    damping: float = 0.85,
    majority: float = 0.5,
    threshold: float = 0.0,
) -> DataFrame:
    """A verdict per page: its longest rule's, else that of its host in the link graph.

    Hosts of which more than ``majority`` of the pages are allowed by rules seed
    trust, those blocked likewise seed distrust. Trust follows the links between
    hosts; distrust follows them backwards, to hosts that point at blocked ones.
    Each kind of seeds shares one unit of score evenly. A host is blocked when
    its distrust exceeds its trust by more than ``threshold``; a host that
    neither reaches is allowed. See :func:`propagate` for ``rounds``.

    Returns ``page_id, host, path, rule, rule_verdict, trust, distrust,
    verdict``, one row per input row. A url that is null or has no ``://`` has
    an empty host, takes no part in the graph and is allowed. Null html has no
    links; repeated rows count as pages of their own; other columns are ignored.
    """
    judged = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
    ).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = settle(
        judged.filter("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")),
        "hosts",
    )
    seeds = hosts.filter(F.col("allowed") > majority).select(F.lit("trust").alias("kind"), "host").union(
        hosts.filter(F.col("blocked") > majority).select(F.lit("distrust").alias("kind"), "host"))
    shares = seeds.groupBy("kind").agg((F.lit(1.0) / F.count(F.lit(1))).alias("seed"))
    # two rows, one per kind
    seeds = settle(seeds.join(F.broadcast(shares), "kind"), "seeds")
    links = settle(host_links(pages, url_col, html_col), "links")
    edges = links.select(F.lit("trust").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "links").union(
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("a"), F.col("source").alias("b"), "links"))
    scores = propagate(edges, seeds, rounds, damping)
    by_host = settle(
        scores.groupBy("host").agg(
            F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
            F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
        ),
        "host-scores",
    )
    # by the stored size of the host table Spark chooses a broadcast or a split join
    joined = judged.join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_graph = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("rule_verdict"),
        "trust", "distrust", F.coalesce(F.col("found.verdict"), by_graph).alias("verdict"),
    )

