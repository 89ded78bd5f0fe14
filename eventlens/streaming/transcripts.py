"""Incremental processing: each transcript file is handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.sources.sinks import replace_partitions
from eventlens.sources.transcripts import CORRUPT, READ_SCHEMA, rejects, transcript_segments, with_stem


def transcript_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of readable transcripts from JSON files as they arrive in a folder."""
    return with_stem(_raw_stream(spark, folder, max_files))


def reject_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of the documents that ``transcript_stream`` leaves out, with the error."""
    return rejects(_raw_stream(spark, folder, max_files))


def _raw_stream(spark: SparkSession, folder: str, max_files: int) -> DataFrame:
    return (
        spark.readStream.schema(READ_SCHEMA)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files)
        .json(folder)
    )


def process_new_transcripts(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = transcript_segments,
    max_files: int = 1000,
    rejected: str | None = None,
) -> None:
    """Apply a row-wise transform to files not seen before and append the result.

    All waiting files are worked through and the call returns. Progress is
    kept in ``checkpoint``, so a rerun or a restart repeats no file. Unreadable
    documents are appended to ``rejected`` if it is given, with progress of
    their own beside the other.
    """
    jobs = [(transform(transcript_stream(spark, folder, max_files)), output, checkpoint)]
    if rejected:
        jobs.append((reject_stream(spark, folder, max_files), rejected, f"{checkpoint.rstrip('/')}-rejected"))
    for rows, path, progress in jobs:
        query = (
            rows.writeStream.format("parquet")
            .option("checkpointLocation", progress)
            .option("path", path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def process_new_batches(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    handle: Callable[[DataFrame, int], None],
    max_files: int = 1000,
) -> None:
    """Hand each batch of new transcripts to ``handle(batch, batch_id)``.

    A batch that was handled but not yet marked as done when a run ended is
    handed over again under the same id; what ``handle`` does must allow for that,
    as :func:`append_new_results` does.
    """
    query = (
        transcript_stream(spark, folder, max_files)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


BATCH = "batch_id"


def append_new_results(
    spark: SparkSession,
    folder: str,
    output: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    max_files: int = 1000,
) -> None:
    """Add ``transform(batch)`` of each batch of new transcripts to ``output``, each once.

    For results that need a whole recording at a time, such as ``verbal_features``.
    Results of a batch are a partition of their own, named by its id. A batch that is
    replayed, because the run ended between writing and marking it as done, replaces
    its partition, so nothing is lost or added twice. ``checkpoint`` belongs to ``output``:
    neither may be used with another.
    """

    def handle(batch: DataFrame, number: int) -> None:
        replace_partitions(transform(batch).withColumn(BATCH, F.lit(number)), output, [BATCH])

    process_new_batches(spark, folder, checkpoint, handle, max_files)


def read_results(spark: SparkSession, output: str) -> DataFrame:
    """What :func:`append_new_results` wrote, without the number of the batch."""
    return spark.read.parquet(output).drop(BATCH)
