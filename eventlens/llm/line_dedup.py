"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import SPACES, ascii_lower, id_and_text
from eventlens.session import scratch_path, settle, settled

KEY = ["h1", "h2"]
_NO_ID = -(1 << 63)  # stands for a null id, below every other


def line_key(line: Column) -> Column:
    """What two lines must share: stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


class LineRuns:
    """Hashes of all lines seen so far, as sorted runs on levels.

    A run is a table of ``h1, h2, n_docs, max_doc`` in ``buckets`` buckets by
    hash, sorted by hash within each. A batch is brought into the same buckets once;
    it is then merge-joined with the runs, and runs are merged with one another,
    bucket by bucket, and no run is ever shuffled again. Runs of the first family never share a key: a new batch is
    anti-joined with them before its own run is added. What the batch has in common with them goes to a second
    family of runs that holds further counts. When ``fanout`` runs stand on a
    level they are merged into one on the next, so ``n`` batches leave about
    ``fanout * log(n)`` runs and every hash is rewritten once per level.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int = 8):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: dict[str, list[list[str]]] = {"first": [], "again": []}
        self.named: list[str] = []

    def _paths(self, family: str) -> list[str]:
        return [path for level in self.levels[family] for path in level]

    def _read(self, family: str) -> DataFrame | None:
        """All rows of a family, wherever they lie."""
        paths = self._paths(family)
        return self.spark.read.parquet(*paths) if paths else None

    def _run(self, path: str) -> DataFrame:
        """A run in its buckets."""
        return self.spark.table(_table(path)).hint("merge")

    def _store(self, run: DataFrame) -> str:
        """Write rows that lie in their buckets already."""
        path = scratch_path(self.spark, "run")
        run.write.option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(_table(path))
        self.named.append(_table(path))
        return path

    def forget(self) -> None:
        """Take the names of all runs out of the catalog, once nothing reads them any more."""
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _both(self, one: str, other: str) -> DataFrame:
        """Two runs merged, bucket by bucket, into one row per hash."""
        a, b = self._run(one).alias("a"), self._run(other).alias("b")
        return a.join(b, KEY, "full_outer").select(
            *KEY,
            (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("a.max_doc", "b.max_doc").alias("max_doc"),
        )

    def _push(self, path: str, family: str, level: int = 0) -> None:
        levels = self.levels[family]
        if level == len(levels):
            levels.append([])
        levels[level].append(path)
        if len(levels[level]) >= self.fanout:
            merged = reduce(lambda one, other: self._store(self._both(one, other)), levels[level])
            levels[level] = []
            self._push(merged, family, level + 1)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with ``h1, h2``) whose hash is in no run."""
        for path in self._paths("first"):
            batch = batch.join(self._run(path).select(*KEY), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of ``doc_id, h1, h2``, one row per document and distinct line.

        The batch is reduced to one row per hash before it is shuffled.
        """
        reduced = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        found = self._store(reduced.repartition(self.buckets, *KEY))
        if not self._paths("first"):
            return self._push(found, "first")
        fresh = self._store(self.unseen(self._run(found)))
        again = self._run(found).join(self._run(fresh).select(*KEY), KEY, "left_anti")
        self._push(self._store(again), "again")
        self._push(fresh, "first")

    def counts(self) -> DataFrame:
        """``h1, h2, n_docs, max_doc`` over everything taken in; the last merge is left to who reads it."""
        *runs, last = self._paths("again") + self._paths("first")
        if not runs:
            return self._run(last)
        return self._both(reduce(lambda one, other: self._store(self._both(one, other)), runs), last)


def _table(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _batched(rows: DataFrame, batches: int) -> DataFrame:
    """A column ``batch``, 0 for the largest ids: later batches hold smaller ones. Only ids are read for it."""
    if batches < 2:
        return rows.withColumn("batch", F.lit(0))
    cuts = rows.agg(
        F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"]
    below = reduce(Column.__add__, [(F.col("doc_id") <= cut).cast("int") for cut in cuts or []], F.lit(0))
    return rows.withColumn("batch", below)


def _among(sorted_keys: Column, key: Column) -> Column:
    """Whether ``key`` is in the sorted array, by steps of falling powers of two."""
    size = F.size(sorted_keys)
    top = F.floor(F.log2(size)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), top), lambda i: F.pow(F.lit(2), top - i).cast("int"))

    def onward(at: Column, step: Column) -> Column:
        return F.when((at + step < size) & (F.get(sorted_keys, at + step) <= key), at + step).otherwise(at)

    return F.get(sorted_keys, F.aggregate(steps, F.lit(0), onward)) == key


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    bucket_rows: int = 4_000_000,
) -> DataFrame:
    """Drop lines that many documents share, except in the document of the largest id.

    A line counts when its key has at least ``min_chars`` code points; a key in
    at least ``min_docs`` documents is dropped everywhere but in the largest id
    that holds it. Documents are taken in ``batches``, each into the runs of a
    :class:`LineRuns` with a bucket per ``bucket_rows`` lines, one per core at least;
    lines are then joined with the keys found to be shared,
    and only the sorted list of a document's own shared keys travels to its text, where
    lines are looked up by halving.

    Returns ``doc_id, text`` (kept lines joined by newline), ``n_lines`` (before
    dropping) and ``n_dropped``. A null or empty text is one empty line. Rows
    that repeat an id count as documents of their own and all keep their lines
    where that id is the largest. A null id counts as the smallest.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    lines = _batched(rows, batches).select(
        "doc_id", "batch", F.explode(F.transform(F.array_distinct(keys), _hashes)).alias("h"),
    ).select("doc_id", "h.h1", "h.h2", "batch")
    spark = docs.sparkSession
    stored = settled(lines, "lines")
    lines = stored.frame.select("doc_id", *KEY)
    runs = LineRuns(spark, buckets=max(spark.sparkContext.defaultParallelism, -(-stored.rows // bucket_rows)))
    for number in range(max(1, batches)):
        runs.add(stored.frame.filter(F.col("batch") == number).select("doc_id", *KEY))
    shared = settle(runs.counts().filter(F.col("n_docs") >= min_docs).select(*KEY, "max_doc"), "shared")
    runs.forget()

    # a line in very many documents meets its key in one partition, which AQE splits
    marks = (
        lines.join(shared, KEY).filter("doc_id < max_doc")
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("marks"))
    )
    joined = rows.join(marks.hint("shuffle_hash"), "doc_id", "left")
    split = _lines(F.col("text"))
    hashed = F.transform(
        split,
        lambda line: F.struct(
            line.alias("line"), F.when(F.length(line_key(line)) >= min_chars, _hashes(line_key(line))).alias("h"),
        ),
    )
    left = F.filter(hashed, lambda x: x["h"].isNull() | ~_among(F.col("marks"), x["h"]))
    kept = F.transform(left, lambda x: x["line"])
    n_lines = F.size(split).cast("long")
    return joined.select("doc_id", "text", n_lines.alias("n_lines"), F.when(F.col("marks").isNotNull(), kept).alias("kept")).select(
        F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(F.array_join("kept", "\n"), F.col("text")).alias("text"),
        "n_lines",
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
