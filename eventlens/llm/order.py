"""Places of rows in an order, without bringing a group to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.session import broadcast_within, settle

# monotonically_increasing_id holds the number of the task above these bits
_TASK_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name``, the place from 0 of each row among those of its ``group`` in ``order``.

    Rows are dealt out by ranges of group and order, so a group of any size is
    spread; rows that tie in everything are spread by where they are stored, and
    take places of their own. A task numbers its rows, and what stands before
    a task's part of a group is a running sum with one row per task and group.
    Null groups are one group. ``rows`` is stored first, then once more in order.
    """
    stored = settle(rows, "unordered")
    salt = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("tie_salt")
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col("tie_salt")]
    ordered = settle(
        stored.select("*", salt).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select(*rows.columns, F.monotonically_increasing_id().alias("sorted_id")),
        "ordered",
    )
    task = F.shiftright("sorted_id", _TASK_BITS)
    before = Window.partitionBy(*group).orderBy("run_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = ordered.groupBy(*group, task.alias("run_task")).agg(
        F.count(F.lit(1)).alias("run_rows"), F.min("sorted_id").alias("run_first"),
    ).withColumn("run_base", F.coalesce(F.sum("run_rows").over(before), F.lit(0)))
    named = runs.select(*[F.col(g).alias(f"run_{g}") for g in group], "run_task", "run_first", "run_base")
    same = [task == F.col("run_task"), *(F.col(g).eqNullSafe(F.col(f"run_{g}")) for g in group)]
    placed = ordered.join(broadcast_within(named), reduce(Column.__and__, same))
    return placed.select(*rows.columns, (F.col("run_base") + F.col("sorted_id") - F.col("run_first")).alias(name))
