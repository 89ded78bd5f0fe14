"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from eventlens.llm.embedding_dedup import cell_bounds, embedding_dedup, fit_codebook, halves, visited_cells
from eventlens.llm.queries import QUERIES
from tests.llm import plain

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def plain_links(rows, least=0.98):
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        v = np.array(vector, np.float32).astype(float)
        usable[i] = (v / np.linalg.norm(v), label)
    close = lambda a, b: (
        usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] >= least
    )
    least_of = plain.components(list(usable), close)
    out = []
    for i, _, _ in rows:
        n = sum(close(i, j) for j in usable if j != i) if i in usable else 0
        component = least_of.get(i, i)
        out.append((i, n, component, i is not None and i == component))
    return sorted(out, key=str)


def clustered(seed: int):
    random = np.random.default_rng(seed)
    rows = []
    for group in range(25):
        centre = random.normal(size=12)
        for _ in range(random.integers(1, 9)):
            spread = random.choice([0.0, 0.01, 0.05, 0.08])
            rows.append((centre + spread * np.linalg.norm(centre) * random.normal(size=12)).astype(np.float32))
            if group % 5 == 0:
                rows.append(rows[-1])
    random.shuffle(rows)
    return [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(rows)]


@pytest.mark.parametrize("index", [{}, {"cell_rows": 2, "block_rows": 4}, {"cell_rows": 8, "block_rows": 3, "sample": 20}])
def test_all_links_in_any_index(spark, index):
    rows = clustered(3)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS weight")
    assert plain.rows_of(embedding_dedup(vectors, **index), *COLUMNS) == plain_links(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
        (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, [1.0, 2.0], None), (None, [1.0, 2.0], 0), (10, [1.0, 2.0, 0.0], 0),
        (11, [2.0, 4.0, 0.0], 0), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0], 0), (14, [3.0], 0), (15, [1e-30, 2e-30], 0),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert plain.rows_of(embedding_dedup(vectors), *COLUMNS) == plain_links(rows)
    assert embedding_dedup(vectors.limit(0)).collect() == []
    twice = vectors.filter("vec_id = 7").union(vectors.filter("vec_id = 7"))
    assert plain.rows_of(embedding_dedup(twice), *COLUMNS) == [(7, 1, 7, True)] * 2


def test_bounds_never_exceed_distances():
    random = np.random.default_rng(0)
    points = random.normal(size=(300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    books = tuple(fit_codebook(half, 6) for half in halves(points))
    own, walk = visited_cells(points, books, 0.5)
    for i, cells in enumerate(walk):
        near = np.linalg.norm(points - points[i], axis=1) <= 0.5
        assert set(own[near]) <= set(cells)
        # nearest cell first
        assert own[i] in cells
    nearest, bound = cell_bounds(points, np.repeat(points[:1], 3, axis=0))
    assert (nearest == 0).all() and not bound.any()


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert plain.rows_of(QUERIES["op6_embedding_dedup"](spark, sf), *COLUMNS) == plain_links(rows)


def test_doubles_beyond_floats(spark):
    rows = [(1, [1e39, 0.0]), (2, [1e39, 0.0]), (3, [1e200, 1e199]), (4, [1e-200, 1e-201]), (5, [1.0, 0.1000000001]), (6, [float("inf"), 0.0]), (7, [-1e300, 0.0])]
    df = spark.createDataFrame([(i, "x", v) for i, v in rows], "vec_id long, label string, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (4, 1), 6: (0, 6), 7: (0, 7)}
