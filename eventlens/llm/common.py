"""Column helpers and registration shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import BROADCAST_BYTES, importable_in_workers, row_bytes, settle

# [\x20\x09-\x0D], the white space of every contract here
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows that Spark hands to Python at a time. Its own limit counts rows, not bytes,
# and 10,000 long texts would not fit beside a worker's state.
BATCH_ROWS = 1024


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches to Python of at most BATCH_ROWS rows in its session from now on.

    The setting changes how much a Python worker holds at once, no result; a
    smaller one that is set already stays. Workers are told where the package is.
    """
    importable_in_workers(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def no_spaces(text: Column) -> Column:
    """``text`` without white space; one byte-level pass per character of SPACES."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` changes other letters too, so it serves texts of ASCII only, for
    which it works on bytes; the rest take the slower character map.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` as names of columns that ``df`` does not have, however its own are spelt."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is a ``doc_id`` of ``dropped``; null ids match nothing.

    Ids that are shown to fit are sent to the documents, so that no text moves;
    more of them are hashed and the documents stream past, so that none is sorted.
    """
    (name,) = free_names(docs, "dropped_id")
    ids = settle(dropped.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    fits = ids.count() * row_bytes(ids) <= BROADCAST_BYTES
    return docs.join(F.broadcast(ids) if fits else ids.hint("shuffle_hash"), docs[id_col].cast("long") == ids[name], "left_anti")
