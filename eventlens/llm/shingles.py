"""Near copies by the share of word shingles two texts have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.bpe import text_blocks
from eventlens.llm.common import id_and_text, in_batches, without_ids
from eventlens.llm.components import components
from eventlens.llm.simhash import HASHES_AT_ONCE, SEED, bit_counts, covering_links
from eventlens.session import broadcast_within, settle

SHINGLE = 5
# Two texts are near copies when NEAR[0] / NEAR[1] of their shingles or more are common.
NEAR = (4, 5)
# Tables, and minima that must agree in one: a pair at 0.8 misses all 32 with
# probability (1 - 0.8^4)^32, once in 20 million.
TABLES, MINIMA = 32, 4
# Shingles permuted at a time: half a megabyte.
AT_ONCE = 512

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, TABLES * MINIMA, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, TABLES * MINIMA, np.uint64)[:, None]
_MIX = _random.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of UTF-8 ``text``, in order.

    Words are those of ``simhash.fingerprint``; fewer than ``shingle`` are one
    shingle, and no word is one empty shingle.
    """
    words = text.lower().split() or [b""]
    width = min(shingle, len(words))
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in joined)
    return np.unique(np.fromiter(hashes, np.uint64, len(words) - width + 1))


def buckets(found: np.ndarray) -> np.ndarray:
    """One bucket per table, as longs: a mix of the table's minima over all shingles."""
    least = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at:at + AT_ONCE] * _FACTORS + _TERMS).min(axis=1), out=least)
    return (least.reshape(TABLES, MINIMA) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a long: bit j is set if over half of them have it."""
    counts = sum(bit_counts(found[at:at + HASHES_AT_ONCE]) for at in range(0, len(found), HASHES_AT_ONCE))
    return int(np.packbits((2 * counts > len(found)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _value(found: np.ndarray) -> int:
    """A long that stands for a set of shingles."""
    value = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _shingled(rows: DataFrame, name: str, of) -> DataFrame:
    """``doc_id, value, size, fingerprint`` of each row and ``of`` its set, a list of longs called ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches):
            sets = [shingle_set(t.encode()) for t in texts]
            values, sizes = pa.array(map(_value, sets), pa.int64()), pa.array(map(len, sets), pa.int64())
            prints = pa.array(map(fingerprint, sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys, values, sizes, prints, _lists([of(s) for s in sets])], ["doc_id", "value", "size", "fingerprint", name],
            )

    return in_batches(rows).mapInArrow(run, f"doc_id long, value long, size long, fingerprint long, {name} array<long>")


def _common_enough(common: Column, a: Column, b: Column) -> Column:
    """In whole numbers, whether ``common`` of two sets of sizes ``a`` and ``b`` reach NEAR."""
    part, whole = NEAR
    return common * (whole + part) >= (a + b) * part


def _common_shingles(sets: DataFrame) -> DataFrame:
    """``value, size, shared`` of the ``sets`` that can have a near copy: ``shared`` are the shingles another set has too.

    What only one set holds is in no intersection, so two sets have in common
    what their shared parts have. A near copy needs NEAR of a set in common at
    least, so a set with a smaller shared part has none and goes. Common
    passages are combined before the shuffle; nothing is listed per shingle.
    """
    each = sets.select("value", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).filter("n = 1")
    own = alone.groupBy("value").agg(F.collect_list("shingle").alias("own"))
    none = F.array().cast("array<long>")
    shared = F.array_except("shingles", F.coalesce("own", none)).alias("shared")
    return sets.join(own, "value", "left").select("value", F.size("shingles").alias("size"), shared).filter(
        F.size("shared") * NEAR[1] >= F.col("size") * NEAR[0],
    )


def _accompanied(members: DataFrame) -> DataFrame:
    """Those of ``members`` whose bucket holds another value."""
    company = members.groupBy("table", "bucket").agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low <> high")
    return members.join(company.select("table", "bucket"), ["table", "bucket"], "left_semi")


def _with_centres(members: DataFrame, shared: DataFrame) -> DataFrame:
    """``table, bucket, value, size, centre``: members that can have a near copy in their bucket, and the bucket's centre.

    With ``n`` shared shingles a set of ``size`` has near copies of at most
    ``n * 9 / 4 - size`` shingles, and goes from buckets whose members are all larger.
    The centre is the member that meets the most others over all its buckets, as an original does among its
    edited copies.
    """
    part, whole = NEAR
    sized = members.select("value", "table", "bucket").join(shared.select("value", "size", F.size("shared").alias("n")), "value")
    least = sized.groupBy("table", "bucket").agg(F.min("size").alias("least"))
    fits = F.col("n") * (whole + part) >= (F.col("size") + F.col("least")) * part
    kept = settle(_accompanied(sized.join(least, ["table", "bucket"]).filter(fits).select("table", "bucket", "value", "size")), "kept")
    crowd = kept.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("crowd"))
    met = settle(kept.join(crowd, ["table", "bucket"]).groupBy("value").agg(F.sum("crowd").alias("met")), "met")
    order = F.struct("met", -F.col("value"))
    centres = kept.join(met, "value").groupBy("table", "bucket").agg(F.max_by("value", order).alias("centre"))
    return settle(kept.join(centres, ["table", "bucket"]), "centred")


def _alike(values: DataFrame) -> DataFrame:
    """``value, table, bucket``: one more table, whose buckets are the components of the values' fingerprints.

    Fingerprints within two bits are linked by the covering masks of ``simhash``.
    """
    links = settle(covering_links(values.select("fingerprint").distinct()), "print-links")
    groups = components(links)
    met = values.join(groups, F.col("fingerprint") == F.col("node"), "left")
    return met.select("value", F.lit(TABLES).alias("table"), F.coalesce("label", "fingerprint").alias("bucket"))


def near_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all near copies that meet in a bucket, as components.

    ``members`` holds ``value, table, bucket``, ``sets`` the shingles of each value.
    First all members of a bucket are compared with its centre, which joins a group of copies
    at once. What is left are buckets whose members are in different components, and
    pairs in them of different components. These are not compared as sets:
    each member knows what it lacks of the centre and what it has besides, so
    two have in common the centre's shingles less all that either lacks, and
    what both have besides. That is exact, and how much one lacks bounds it from
    above before lists are looked at. Members whose bound no partner in the
    bucket could meet go first. Pairs never leave the join unless they are links.
    """
    part, whole = NEAR
    shared = settle(_common_shingles(sets), "shared")
    centred = _with_centres(members, shared)
    of = lambda side: shared.select(
        F.col("value").alias(side), F.col("shared").alias(f"{side}_set"), F.col("size").alias(f"{side}_size"))
    pairs = centred.filter("value <> centre").select(F.col("value").alias("a"), F.col("centre").alias("b")).distinct()
    # b is one value for many a, so its set comes last
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    deltas = settle(
        both.select(
            F.col("a").alias("value"), F.col("b").alias("centre"), F.col("b_size").alias("centre_size"),
            F.size("b_set").alias("whole"), F.array_except("b_set", "a_set").alias("lacks"), F.array_except("a_set", "b_set").alias("has"),
            (F.size("b_set") - F.size(F.array_except("b_set", "a_set"))).alias("common"), F.col("a_size").alias("size"),
        ),
        "deltas",
    )
    near = deltas.filter(_common_enough(F.col("common"), F.col("size"), F.col("centre_size")))
    links = settle(near.select(F.col("value").alias("a"), F.col("centre").alias("b")), "links")
    label = F.coalesce("label", "value").alias("label")
    # centres have met all others
    others = centred.filter("value <> centre").join(components(links), F.col("value") == F.col("node"), "left").select(
        "table", "bucket", "value", "centre", label,
    )
    labelled = settle(others, "labelled")
    apart = labelled.groupBy("table", "bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    rest = labelled.join(apart.select("table", "bucket"), ["table", "bucket"], "left_semi").join(deltas, ["value", "centre"])
    extremes = rest.groupBy("table", "bucket").agg(F.min("size").alias("least"), F.max(F.size("has")).alias("most"))
    # the least a partner can have, by its size and by the sizes in the bucket
    partner = F.greatest(F.ceil(F.col("size") * part / F.lit(whole)), F.col("least"))
    could = (F.col("common") + F.least(F.size("has"), F.col("most"))) * (whole + part) >= (F.col("size") + partner) * part
    rest = settle(rest.join(extremes, ["table", "bucket"]).filter(could).drop("least", "most"), "rest")
    fields = ("value", "size", "label", "lacks", "has", "common")
    other = rest.select("table", "bucket", *[F.col(c).alias(f"o_{c}") for c in fields])
    most = F.least("common", "o_common") + F.least(F.size("has"), F.size("o_has"))
    exact = F.col("whole") - F.size(F.array_union("lacks", "o_lacks")) + F.size(F.array_intersect("has", "o_has"))
    second = rest.join(
        other,
        (rest["table"] == other["table"]) & (rest["bucket"] == other["bucket"]) & (F.col("value") > F.col("o_value"))
        & (F.col("label") != F.col("o_label"))
        & _common_enough(most, F.col("size"), F.col("o_size")) & _common_enough(exact, F.col("size"), F.col("o_size")),
    )
    return links.union(second.select(F.col("value").alias("a"), F.col("o_value").alias("b")).distinct())


def shingle_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``, one row per row with an id: the smallest id reachable over near copies.

    Two texts are near copies when at least 0.8 of all five-word shingles that
    either has are in both. Candidates are texts whose SimHash over these shingles differs in at most two bits,
    found by covering masks and joined over such links (:func:`_alike`); texts at 0.8 may differ in a dozen
    bits, and tables of MinHash buckets find these. Every link, of either kind, is checked on the
    whole sets (:func:`near_links`), which are made again for texts with company only. Equal sets
    meet once, as one value.

    A null text is empty. Texts without a word are copies of one another, and a
    text of fewer than five words is one shingle. Rows that repeat an id are
    linked each by its text, and each gets a row. Rows without id take no part;
    without rows there is no result. Other columns are ignored and may have any name.
    """
    rows = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    found = settle(_shingled(rows, "buckets", buckets), "buckets")
    values = settle(
        found.groupBy("value").agg(F.min("doc_id").alias("first"), F.min("fingerprint").alias("fingerprint")), "values",
    )
    chosen = found.join(values, (found["value"] == values["value"]) & (F.col("doc_id") == F.col("first")), "left_semi")
    keyed = chosen.select("value", F.posexplode("buckets").alias("table", "bucket"))
    members = settle(_accompanied(keyed.unionByName(_alike(values))).distinct(), "members")
    met = members.select("value").distinct().join(values, "value").select(F.col("first").alias("doc_id"), F.col("value").alias("of"))
    wanted = broadcast_within(met)
    texts = rows.join(wanted.select("doc_id"), "doc_id", "left_semi")
    made = _shingled(texts, "shingles", lambda s: s)
    sets = settle(made.join(wanted.withColumnRenamed("of", "value"), ["doc_id", "value"], "left_semi"), "sets")
    groups = settle(components(settle(near_links(members, sets), "links")), "groups")
    linked = settle(values.join(groups, F.col("value") == F.col("node")).select("value", "first", "label"), "linked")
    ids = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    in_group = settle(linked.join(ids, "label").select("value", "component_id"), "components")
    joined = found.select("doc_id", "value").join(values, "value").join(in_group, "value", "left")
    return joined.select("doc_id", F.coalesce("component_id", "first").alias("component_id"))


def keep_one_shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of :func:`shingle_dedup`, that of its smallest id.

    Rows without id are kept, since a decision is taken back to its row by id.
    """
    dropped = shingle_dedup(docs, id_col, text_col).filter("doc_id <> component_id")
    return without_ids(docs, dropped, id_col)
