"""Transcript JSON: recordings with a list of timed text segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens import schemas
from eventlens.functions.text import path_stem

CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType([*schemas.TRANSCRIPT.fields, T.StructField(CORRUPT, T.StringType())])
# Fixed value of the error column of an unreadable document.
UNREADABLE = "unreadable transcript"


def file_path() -> Column:
    """Path of a row's file as it is named in its folder; readers give it percent-encoded."""
    encoded = F.col("_metadata.file_path")
    # a plus sign is itself here, not a blank
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)


def with_stem(raw: DataFrame) -> DataFrame:
    """Readable documents, each named by its ``file_stem`` field, else by its file."""
    return raw.where(F.col(CORRUPT).isNull()).select(
        F.coalesce("file_stem", path_stem(file_path())).alias("file_stem"), "first_segment", "segments"
    )


def rejects(raw: DataFrame) -> DataFrame:
    """``file_stem, record, error`` of documents that cannot be read or hold a value of a wrong type."""
    # whether a document fits is known only where its fields are read
    read = F.coalesce(F.size("segments"), "first_segment", F.length("file_stem"), F.lit(-1)) >= -1
    return raw.where(F.col(CORRUPT).isNotNull() & read).select(
        path_stem(file_path()).alias("file_stem"), F.col(CORRUPT).alias("record"), F.lit(UNREADABLE).alias("error")
    )


def raw_transcripts(spark: SparkSession, path: str | list[str], per_file: bool = False) -> DataFrame:
    """Documents as read, for :func:`with_stem` and :func:`rejects`."""
    reader = spark.read.schema(READ_SCHEMA).option("columnNameOfCorruptRecord", CORRUPT)
    if per_file:
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.json")
    return reader.json(path)


def read_transcripts(spark: SparkSession, path: str | list[str], per_file: bool = False) -> DataFrame:
    """Transcripts as ``file_stem, first_segment, segments``.

    By default files hold one JSON document per line, which suits many
    recordings per file. With ``per_file`` each file is one document, possibly
    over several lines. A recording of many segments can be several documents
    of one stem whose ``first_segment`` tells where each begins.
    """
    return with_stem(raw_transcripts(spark, path, per_file))


def transcript_rejects(spark: SparkSession, path: str | list[str], per_file: bool = False) -> DataFrame:
    """What :func:`read_transcripts` leaves out: ``file_stem`` (of the file), ``record, error``."""
    return rejects(raw_transcripts(spark, path, per_file))


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """One row per segment; a transcript without segments keeps one row of NULLs.

    Segments are numbered over the documents of a recording.
    """
    first = F.coalesce("first_segment", F.lit(0)) if "first_segment" in transcripts.columns else F.lit(0)
    return transcripts.select(
        "file_stem", first.alias("first"), F.posexplode_outer("segments").alias("pos", "segment")
    ).select("file_stem", (F.col("first") + F.col("pos")).alias("seg_no"), "segment.start", "segment.end", "segment.text")
