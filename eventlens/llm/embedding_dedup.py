"""Embedding near-duplicates over an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import in_batches
from eventlens.llm.components import components
from eventlens.session import settle

Codebooks = tuple[np.ndarray, np.ndarray]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; squares of very large or small components would leave the range of doubles."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = np.where((largest > 1e100) | (largest < 1e-100), vectors / largest, vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_codebook(points: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """``size`` centroids of ``points`` by k-means from evenly spaced starts."""
    centroids = points[np.linspace(0, len(points) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        nearest = _square_distances(points, centroids).argmin(axis=1)
        for k in range(size):
            own = points[nearest == k]
            if len(own):
                centroids[k] = own.mean(axis=0)
    return centroids


def _square_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None]


def halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return vectors[:, :cut], vectors[:, cut:]


def cell_bounds(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each point, and how far it is at least from every cell.

    A point of cell i is nearer to centroid i than to any other k, so it lies
    beyond the plane halfway between them; the distance to that plane, largest
    over k, is a lower bound of the distance to the cell.
    """
    squares = _square_distances(points, centroids)
    apart = np.sqrt(np.maximum(_square_distances(centroids, centroids), 0))
    bound = np.zeros_like(squares)
    for k in range(len(centroids)):
        gap = 2 * apart[k][None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 1e-9, (squares - squares[:, k:k + 1]) / gap, 0)
        np.maximum(bound, plane, out=bound)
    return squares.argmin(axis=1), bound


def visited_cells(vectors: np.ndarray, codebooks: Codebooks, radius: float) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Own cell of each unit vector, and the cells that can hold a vector within ``radius`` of it.

    The multi-sequence: both lists of half-cells are taken by rising bound, and
    the grid is walked while the sum of the squared bounds stays within the
    radius. Distances add up over the halves, so no cell beyond can hold a
    partner and the recall aimed at is one.
    """
    (own_a, bound_a), (own_b, bound_b) = (
        cell_bounds(half, book) for half, book in zip(halves(vectors), codebooks, strict=True)
    )
    width = len(codebooks[1])
    limit = radius**2 + 1e-9

    def walk() -> Iterator[np.ndarray]:
        order_a, order_b = np.argsort(bound_a, axis=1), np.argsort(bound_b, axis=1)
        for row in range(len(vectors)):
            first, second = order_a[row], order_b[row]
            near_a, near_b = bound_a[row][first] ** 2, bound_b[row][second] ** 2
            reach = np.searchsorted(near_b, limit - near_a, side="right")
            yield np.concatenate([a * width + second[:n] for a, n in zip(first, reach, strict=True) if n])

    return own_a * width + own_b, walk()


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _forest(hits: np.ndarray, group: np.ndarray, row_ids: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what ``hits`` (rows by targets) joins, at most one per merged group.

    ``group`` numbers the targets already joined and is updated.
    """
    for row in np.flatnonzero(hits.any(axis=1)):
        linked = np.flatnonzero(hits[row])
        found, first = np.unique(group[linked], return_index=True)
        for at in linked[first]:
            yield int(row_ids[row]), int(ids[at])
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]


class _Cell:
    """Targets of one block of a cell, against which queries are compared as they come."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, least: float):
        self.ids, self.weights, self.least = ids, weights, least
        self.vectors = _unit(vectors)
        self.counts = np.zeros(len(ids))
        self.group = np.arange(len(ids))

    def among(self) -> Iterator[tuple[int, int | None, int]]:
        hits = np.tril(self.vectors @ self.vectors.T >= self.least, -1)
        self.counts += hits @ self.weights + hits.T @ self.weights
        for row in np.flatnonzero(hits.any(axis=1)):
            for a, b in _forest(hits[row:row + 1], self.group, self.ids[row:row + 1], self.ids):
                yield a, b, 0
            joined = np.unique(self.group[np.append(np.flatnonzero(hits[row]), row)])
            self.group[np.isin(self.group, joined)] = joined[0]

    def against(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
        hits = _unit(vectors) @ self.vectors.T >= self.least
        if not hits.any():
            return
        self.counts += weights @ hits
        own = hits @ self.weights
        for row in np.flatnonzero(own):
            yield int(ids[row]), None, int(own[row])
        for a, b in _forest(hits, self.group, ids, self.ids):
            yield a, b, 0

    def close(self) -> Iterator[tuple[int, int | None, int]]:
        for at in np.flatnonzero(self.counts):
            yield int(self.ids[at]), None, int(self.counts[at])


def _compare(least: float):
    """Task function: streams sorted ``unit, is_query, id, weight, embedding`` rows.

    The targets of a unit come first and are held, at most a block of them;
    its queries follow and are only passed through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, cell = None, [], None

        def opened() -> Iterator[tuple]:
            nonlocal cell, waiting
            ids, weights, vectors = (np.concatenate(x) for x in zip(*waiting, strict=True))
            cell, waiting = _Cell(ids, weights, vectors, least), []
            yield from cell.among()

        def closed() -> Iterator[tuple]:
            nonlocal cell, waiting
            if waiting:
                yield from opened()
            if cell is not None:
                yield from cell.close()
            cell, waiting = None, []

        for batch in batches:
            units, queries = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((units[1:] != units[:-1]) | (queries[1:] != queries[:-1])) + 1
            made: list[tuple] = []
            for a, b in zip([0, *change], [*change, len(units)], strict=True):
                for begin in range(a, b, 1024):
                    size = min(1024, b - begin)
                    part = batch.slice(begin, size)
                    if units[begin] != unit:
                        made.extend(closed())
                        unit = units[begin]
                    rows = part.column(2).to_numpy(), part.column(3).to_numpy(), _vectors(part.column(4))
                    if not queries[begin]:
                        waiting.append(rows)
                        continue
                    if waiting:
                        made.extend(opened())
                    if cell is not None:
                        made.extend(cell.against(*rows))
            yield _links(made)
        yield _links(list(closed()))

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"],
    )


def _assign(codebooks: Codebooks, radius: float):
    """Task function: the own cell of each vector, and the later cells it has to look in.

    A pair is found from the vector whose cell comes first, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, walk = visited_cells(_unit(_vectors(batch.column(3))), codebooks, radius)
            later = [cells[cells > o].astype(np.int64) for cells, o in zip(walk, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int64)), pa.array(later, pa.list_(pa.int64()))],
                ["label", "id", "weight", "embedding", "own", "visits"],
            )

    return run


def link_vectors(
    points: DataFrame, least: float, sample: int = 8192, cell_rows: int = 128, block_rows: int = 1024, max_size: int = 64,
) -> DataFrame:
    """``a, b, n`` over distinct vectors ``label, id, weight, embedding`` of one length.

    Rows with ``b`` are links that connect whatever is linked; rows without
    carry a part of the summed weight of the vectors linked to ``a``.
    """
    radius = float(np.sqrt(2 - 2 * least))
    total, labels = points.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    size = int(np.clip(np.ceil(np.sqrt(total / max(1, labels) / cell_rows)), 1, max_size))
    # the codebooks alone rest on a sample, of bounded size and chosen by hash
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    fitted = _unit(np.array([r[0] for r in drawn], np.float64))
    size = min(size, len(fitted))
    books = tuple(fit_codebook(half, size) for half in halves(fitted))

    kinds = dict(points.dtypes)
    schema = f"label {kinds['label']}, id long, weight long, embedding {kinds['embedding']}, own long, visits array<long>"
    placed = settle(in_batches(points).mapInArrow(_assign(books, radius), schema), "placed")
    blocks = settle(
        placed.groupBy("label", F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")),
        "blocks",
    )
    in_cell = placed.withColumnRenamed("own", "cell").join(blocks, ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")),
    )
    targets = in_cell.select("label", "cell", "block", F.lit(False).alias("is_query"), "id", "weight", "embedding")
    # a cell of several blocks: every block is also compared with the later ones
    same_cell = in_cell.filter("blocks > 1 AND block + 1 < blocks").select(
        "label", "cell", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("is_query"), "id", "weight", "embedding",
    )
    visits = placed.select("label", "id", "weight", "embedding", F.explode("visits").alias("cell")).join(
        blocks, ["label", "cell"],
    ).select(
        "label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(True).alias("is_query"), "id", "weight", "embedding",
    )
    rows = targets.unionByName(same_cell).unionByName(visits).select(
        F.xxhash64("label", "cell", "block").alias("unit"), "is_query", "id", "weight", "embedding",
    )
    return in_batches(rows).repartition("unit").sortWithinPartitions("unit", "is_query").mapInArrow(
        _compare(least), "a long, b long, n long",
    )


def embedding_dedup(
    vectors: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    **index: int,
) -> DataFrame:
    """Near-duplicate components of vectors that share a label.

    Returns one row per input row: ``vec_id, n_links`` (other vectors of cosine
    ``least`` or more, in double precision), ``component_id`` (smallest id
    reachable, itself included) and ``kept`` (the id is the component's).

    Equal vectors of a label are one point with a weight. Points are indexed by
    the cells of the product of two codebooks, visited as :func:`visited_cells`
    says and compared cell by cell in blocks; a task holds one block. Only links
    that connect, and counts, leave a comparison.

    Vectors that are null, zero or hold null or non-finite components, and rows
    without label or id, link with nothing. Vectors of different length are not
    compared. Repeated rows count as vectors of their own and are linked; rows
    of one id are one node. Other columns are ignored.
    """
    # floats travel as floats; what does not fit them stays in double precision
    element = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast(f"array<{element}>").alias("embedding"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(F.forall("embedding", finite), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    keyed = settle(
        rows.withColumn("usable", usable).withColumns({
            "k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit("vector"), "label", "embedding"),
        }),
        "vectors",
    )
    points = settle(
        keyed.filter("usable").groupBy("k1", "k2").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ),
        "points",
    )
    lengths = [r[0] for r in points.select(F.size("embedding").alias("n")).distinct().collect()]
    found = None
    for length in sorted(lengths):
        own = points.filter(F.size("embedding") == length).select("label", "id", "weight", "embedding")
        links = link_vectors(own, least, **index)
        found = links if found is None else found.unionByName(links)
    alone = keyed.filter("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.col("vec_id").isNotNull().alias("kept"),
    )
    if found is None:
        return alone
    found = settle(found, "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    groups = components(found.filter("b IS NOT NULL").select("a", "b"))
    nodes = settle(
        points.select("k1", "k2", "id", "weight").join(counts, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("label", "id").alias("component_id")),
        "nodes",
    )
    linked = keyed.filter("usable").join(nodes, ["k1", "k2"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"),
    )
    return linked.unionByName(alone)
