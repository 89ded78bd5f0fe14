"""Session settings, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes a lookup side may have before it is joined by shuffle instead. A market
# series of ten years of five-minute bars is about 120,000 rows, or 2 MB.
BROADCAST_BYTES = 64 << 20
# Counted for a value without a fixed size: text, arrays, structs.
_VARIABLE_BYTES = 48


def build_session(app: str = "eventlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE sizes and splits shuffle partitions at run time, so the initial number
    can be generous on a cluster; UTC keeps bar times equal to wall-clock input.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # wide summaries carry 84 measures, over the default limit of 100
        # fields once sums and counts are both buffered
        "spark.sql.codegen.maxFields": "400",
        # the JVM never compiles a method of more than 8,000 bytes; where the code of a
        # stage passes that, as with 84 means, its operators run one by one and compiled
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # skip recording a Python call site per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, used for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    that setting gets a new temporary folder; a cluster session without it is
    refused, since a driver-local folder would be unreadable elsewhere.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables made inside when the block ends.

    For jobs that write their results: a frame that still reads a scratch table
    must not leave the block.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)


def settle(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute once into a table of the shared folder and read that instead.

    Later steps then repeat no earlier one when an executor is lost, read only
    the columns they use, and see the true size of the data.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable_in_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    Workers inherit ``PYTHONPATH`` and the working directory, not ``sys.path``. The
    folder is passed on to workers started for functions made afterwards, which
    serves local sessions and clusters that mount it; others ship the package.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


# Rows and bytes that Spark hands to a Python worker at a time. Its own limit of 10,000 rows says nothing
# of bytes, and tokens of a text take ten times its size in Python.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches() -> None:
    """Let Spark hand at most BATCH_ROWS rows to Python at a time, of about BATCH_BYTES, in the active session from now on.

    This bounds what a worker holds at once, whatever the size of the input, and changes no result;
    smaller limits that are set already stay.
    """
    conf = SparkSession.active().conf
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for key, most in limits.items():
        if not 0 < int(conf.get(key).removesuffix("b")) <= most:
            conf.set(key, most)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores when it has fewer splits than cores.

    For work that is heavy per row on few files. Large inputs have more splits
    than cores and are left as they are. Meant for scans only: asking for the
    number of partitions would run the shuffles of a longer plan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory, about: 8 per number, more for text and nested values."""
    fixed = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return sum(8 if isinstance(f.dataType, fixed) else _VARIABLE_BYTES for f in df.schema.fields)


def fits(df: DataFrame, rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` rows of ``df`` have about ``max_bytes`` at most."""
    return rows * row_bytes(df) <= max_bytes


@dataclass(frozen=True)
class Settled:
    """A stored frame and what its writing counted: ``rows`` and the named ``values``."""

    frame: DataFrame
    rows: int
    values: dict

    def broadcastable(self, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """The frame, with a broadcast hint when its rows are shown to have about ``max_bytes`` at most."""
        return F.broadcast(self.frame) if fits(self.frame, self.rows, max_bytes) else self.frame


def settled(df: DataFrame | Settled, name: str = "stage", **values: Column) -> Settled:
    """:func:`settle` that also observes the number of rows and the aggregates ``values`` while it writes.

    No job is run for them. A frame that is settled already is passed on; its
    values are those it was settled with, or are computed if it lacks any.
    """
    if isinstance(df, Settled):
        if all(v in df.values for v in values):
            return df
        found = df.frame.agg(*[c.alias(n) for n, c in values.items()]).first()
        return Settled(df.frame, df.rows, {**df.values, **found.asDict()})
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in values.items()])
    stored = settle(observed, name)
    found = seen.get
    return Settled(stored, found["rows"], {n: found[n] for n in values})


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when ``df`` is shown to have about ``max_bytes`` at most.

    The frame is settled first, so that counting and joining read one stored
    copy whichever way it is joined; rows are counted as they are written. Beyond
    the bound it is returned without a hint and joined by shuffle.
    """
    return settled(df, "lookup").broadcastable(max_bytes)
