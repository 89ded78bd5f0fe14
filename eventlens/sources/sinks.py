"""Writers. Spark writes files in parallel, so batching needs no care here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


def _write(df: DataFrame, path: str, fmt: str, mode: str, partition_by: list[str] | None) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def sink_overwrite(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Replace the output by this result."""
    _write(df, path, fmt, "overwrite", partition_by)


def sink_append(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Add this result to the output."""
    _write(df, path, fmt, "append", partition_by)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows for, and no other file of the output.

    The new files are written aside and moved in when all are complete, so a job
    that fails leaves the old ones, and one that is repeated gives the same
    output. ``df`` must not read ``path`` itself: settle it first. A partition of which ``df``
    has no row stays.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def sink_counted(df: DataFrame, path: str, fmt: str = "parquet", **measures: Column) -> dict[str, int]:
    """Replace the output by this result and give aggregates of it, observed while it is written.

    No second job reads the result or computes it again.
    """
    seen = Observation()
    sink_overwrite(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), path, fmt)
    return {n: seen.get[n] for n in measures}
