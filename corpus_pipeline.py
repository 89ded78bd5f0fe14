"""The corpus pipeline: from ``documents`` to packed sequences of tokens.

Low-quality documents go, then exact copies, then near copies; secrets are
blanked in the texts that stay, and these are packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.exact_dedup import keep_one_copy
from eventlens.llm.packing import pack
from eventlens.llm.quality import keep_quality, train
from eventlens.llm.secrets import redact_secrets
from eventlens.llm.shingles import keep_one_shingled
from eventlens.session import settle


# Every stage takes any columns beside those it reads, under any name, and returns
# them unchanged (packing returns pieces). A null text is empty, texts are read whole, rows
# that repeat an id or a text are rows of their own, and without rows there is no result.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier keeps; null and empty texts are scored as empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, train(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, empty ones a group; rows without id stay."""
    return keep_one_copy(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles; rows without id stay.

    Candidates by SimHash and covering masks, beyond two bits by MinHash; every link is checked.
    """
    return keep_one_shingled(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked; a text without any stays as it is, null included."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens: their ids (unsigned 32-bit, little-endian) and a checksum of them."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("secret scans", secrets),
    ("packing", packing),
]

# SQL cannot express the classifier; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on the whole output of the one before it, which is stored between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs, f"stage{number}")
    return docs
