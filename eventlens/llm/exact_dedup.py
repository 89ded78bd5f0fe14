"""Exact deduplication by progressive refinement: length, then prefix, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import id_and_text, no_spaces, without_ids
from eventlens.session import settle

# Survivors of a level are remembered by slot, so a level's filter has at most
# this many rows of one long however large the corpus is. Two keys sharing a
# slot only cause a hash that was not needed.
SLOTS = 1 << 20


def _repeated(level: DataFrame, keys: list[str], slots: int, name: str) -> DataFrame:
    """Slots of the keys that more than one row has: at most ``slots`` rows."""
    often = level.groupBy(*keys).count().filter("count > 1")
    return settle(often.select(_slot(keys, slots).alias("slot")).distinct(), name)


def _slot(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = 256,
    slots: int = SLOTS,
    hash_all: bool = False,
) -> DataFrame:
    """Groups of texts that are equal once white space is deleted.

    Level 1 counts normalised lengths. Level 2 hashes the first ``prefix``
    characters of rows whose length is shared. Level 3 takes the SHA-256 of the
    whole text, only of rows whose length and prefix are shared (of all rows
    with ``hash_all``), and only those meet in a group. Between levels travel
    counts and slots; texts are never shuffled.

    Of a group the row with the most code points in the original text stays,
    then the smallest id. Returns one row per input row: ``doc_id, keep_id,
    group_size, kept, text_hash`` (binary, null where level 3 was not reached).

    A null text is empty, and empty texts are one group. Rows that repeat an id
    count each and share the decision. Rows without id stay only when nothing
    in their group has one (``keep_id`` is null then). Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    body = no_spaces(F.col("text"))
    by_length = rows.select(F.octet_length(body).alias("size"))
    lengths = _repeated(by_length, ["size"], slots, "lengths")

    sized = rows.select("doc_id", "text", body.alias("body")).withColumn("size", F.octet_length("body"))
    same_length = sized.withColumn("slot", _slot(["size"], slots)).join(F.broadcast(lengths), "slot", "left_semi")
    by_prefix = same_length.select("size", F.xxhash64(F.substring("body", 1, prefix)).alias("head"))
    prefixes = _repeated(by_prefix, ["size", "head"], slots, "prefixes")

    marked = (
        sized.withColumn("head", F.xxhash64(F.substring("body", 1, prefix)))
        .withColumn("slot", _slot(["size", "head"], slots))
        .join(F.broadcast(prefixes.withColumn("shared", F.lit(True))), "slot", "left")
        .withColumn("shared", F.coalesce("shared", F.lit(False)))
    )
    full = F.unhex(F.sha2("body", 256))
    hashed = settle(
        marked.select(
            "doc_id",
            F.length("text").alias("points"),
            "shared",
            (full if hash_all else F.when(F.col("shared"), full)).alias("text_hash"),
        ),
        "hashed",
    )
    alone = hashed.filter("not shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_hash",
    )
    shared = hashed.filter("shared")
    # rows without id come last whatever their length
    first = F.min(F.struct(F.col("doc_id").isNull(), -F.col("points"), F.col("doc_id")))
    # stored, so that the join below stands on two shuffles of its own and AQE can split a large group
    groups = settle(
        shared.groupBy("text_hash").agg(
            F.count(F.lit(1)).alias("group_size"),
            first.getField("doc_id").alias("keep_id"),
        ),
        "groups",
    )
    joined = shared.join(groups, "text_hash").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_hash",
    )
    return joined.unionByName(alone)


def keep_one_copy(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` drops, all columns kept.

    Rows without id are kept, since a decision is taken back to its row by id.
    """
    dropped = exact_dedup(docs, **options).filter("not kept")
    return without_ids(docs, dropped, str(options.get("id_col", "doc_id")))
