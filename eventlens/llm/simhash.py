"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import id_and_text, in_batches, without_ids
from eventlens.llm.components import components
from eventlens.session import settle

BITS = 64
SEED = 42
# Shingle hashes whose bits are counted at a time: 4 MB of unpacked bits.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 ``text``: bit j is set if over half the shingle hashes have it.

    Words are split at ASCII white space after A-Z is lower-cased (``bytes``
    methods touch ASCII only). Repeated shingles count each time; fewer words
    than ``shingle`` are one shingle, and no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    counts = np.zeros(BITS, np.int64)
    total, block = 0, []
    for joined in shingles:
        block.append(xxhash.xxh64_intdigest(joined, SEED))
        if len(block) == HASHES_AT_ONCE:
            counts += bit_counts(block)
            total, block = total + len(block), []
    if block:
        counts += bit_counts(block)
        total += len(block)
    bits = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bytes_of = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(bytes_of, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (a long holding the 64 bits), one row per input row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(text.as_py(), shingle) for text in batch.column(1))
            values = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fingerprint"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return in_batches(rows).mapInArrow(of, "doc_id long, fingerprint long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` positions are all zero in one of them.

    Position i gets a nonzero vector f(i) of radius + 1 bits, dealt round; mask
    v keeps the positions where f(i) and v have an odd number of common bits.
    For any ``radius`` vectors some nonzero v is orthogonal to all of them, so
    two values that differ there only agree under mask v (Pagh, SODA 2016).
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [
        sum(1 << i for i, f in enumerate(vectors) if (f & v).bit_count() % 2)
        for v in range(1, size + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def covering_links(values: DataFrame, radius: int = 2) -> DataFrame:
    """Links that join all ``fingerprint`` values within ``radius`` bits (2) of each other.

    ``values`` holds distinct fingerprints. Each goes to a bucket of every
    covering table; only buckets with company are looked at further. There a
    value differs from its partners in the bits the mask leaves out, so two
    within two bits of each other share a midpoint: a value at most one of those
    bits away from both. Members therefore emit their midpoints and every
    midpoint links its members to the smallest of them. All members of a
    midpoint are within two bits of each other, so no link is wrong, and none is
    lost as a connection; a midpoint has at most one member per free bit, so no
    group grows with a bucket and a bucket of n costs about 30 n rows.

    Returns distinct links ``a, b`` with ``b < a``.
    """
    if radius != 2:
        raise ValueError("midpoints verify a radius of two bits")
    masks = covering_masks(radius)
    full = (1 << BITS) - 1
    free = [[0] + [1 << i for i in range(BITS) if (full & ~m) >> i & 1] for m in masks]
    tables = F.posexplode(_longs(masks)).alias("table", "mask")
    keyed = values.select("fingerprint", tables).select(
        "fingerprint", "table", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bucket"),
    )
    company = keyed.groupBy("table", "bucket").count().filter("count > 1").select("table", "bucket")
    members = keyed.join(company, ["table", "bucket"])
    bits = F.element_at(F.array(*[_longs(f) for f in free]), F.col("table") + 1)
    midpoints = members.select("table", "fingerprint", F.explode(bits).alias("bit")).select(
        "table", F.col("fingerprint").bitwiseXOR(F.col("bit")).alias("midpoint"), "fingerprint",
    )
    met = midpoints.groupBy("table", "midpoint").agg(F.collect_list("fingerprint").alias("members")).filter("size(members) > 1")
    least = F.array_min("members")
    pairs = met.select(least.alias("b"), F.explode("members").alias("a"))
    return pairs.filter("a <> b").select("a", "b").distinct()


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
) -> DataFrame:
    """Near-duplicate components of documents.

    Returns one row per input row: ``doc_id, fingerprint`` (long) and
    ``component_id``, the smallest id reachable over links of at most ``radius``
    differing bits. Equal fingerprints meet once, as one value, so copies cost
    nothing; values without company never enter the component search.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows without id take the component of the others and give no id to it
    (null if no row of the component has one). Repeated rows count once each.
    """
    found = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    values = settle(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "values")
    links = settle(covering_links(values.select("fingerprint"), radius), "links")
    groups = components(links)
    linked = values.join(groups, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", "label",
    )
    linked = settle(linked, "linked")
    group_ids = linked.filter("label is not null").groupBy("label").agg(F.min("first").alias("component_id"))
    in_group = linked.filter("label is not null").join(group_ids, "label").select("fingerprint", "component_id")
    alone = linked.filter("label is null").select("fingerprint", F.col("first").alias("component_id"))
    of_value = settle(in_group.unionByName(alone), "components")
    return found.join(of_value, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one_near_copy(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with one document of each component of :func:`simhash_dedup`, that of its smallest id.

    Rows without id are kept, since a decision is taken back to its row by id.
    """
    dropped = simhash_dedup(docs, **options).filter("doc_id <> component_id")
    return without_ids(docs, dropped, str(options.get("id_col", "doc_id")))
