"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import free_names, in_batches

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "symbols", "pipes", "cries",
    "other_marks", "spaces", "line_bytes", "beyond_ascii", "entropy", "distinct_words", "same_lines", "middle_word",
]
# Labelled rows the model is fitted on at most; the one thing here that rests on a sample.
MAX_ROWS = 20_000
CUTOFF = 0.3


def _members(characters: str) -> np.ndarray:
    found = np.zeros(256)
    found[list(characters.encode())] = 1
    return found


_CLASSES = {
    "upper": _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _members("abcdefghijklmnopqrstuvwxyz"),
    "digits": _members("0123456789"), "stops": _members(".,;:"), "symbols": _members("#$%&*+=<>@^~\\"),
    "pipes": _members("|"), "cries": _members("!?"), "other_marks": _members("\"'()[]{}/_-`"),
    "spaces": _members(" \t\n\v\f\r"), "lines": _members("\n"),
    "beyond_ascii": np.repeat([0.0, 1.0], 128),
}
_MATRIX = np.stack(list(_CLASSES.values()), axis=1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per whole text of a binary array; a null text is empty.

    Everything but the figures on words and lines follows from a count of bytes.
    """
    n = len(texts)
    histogram = np.zeros((n, 256))
    words, distinct, middle, line_repeats = (np.zeros(n) for _ in range(4))
    for row, text in enumerate(texts):
        raw = text.as_py() or b""
        histogram[row] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        parts = raw.split()
        words[row] = len(parts)
        kinds = set(parts)
        distinct[row] = len(kinds)
        lines = raw.split(b"\n")
        line_repeats[row] = 1 - len(set(lines)) / len(lines)
        if parts:
            middle[row] = parts.count(parts[len(parts) // 2]) / len(parts)
    size = histogram.sum(axis=1)
    share = histogram / np.maximum(size, 1)[:, None]
    of = dict(zip(_CLASSES, (share @ _MATRIX).T, strict=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log2(share), 0), axis=1)
    letters = of["upper"] + of["lower"]
    columns = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(words),
        "word_bytes": size * (1 - of["spaces"]) / np.maximum(words, 1),
        "upper": of["upper"] / np.maximum(letters, 1e-9),
        "line_bytes": np.log1p(size / (1 + of["lines"] * size)),
        "entropy": entropy,
        "distinct_words": distinct / np.maximum(words, 1),
        "same_lines": line_repeats,
        "middle_word": middle,
    }
    return np.stack([columns[name] if name in columns else of[name] for name in FEATURES], axis=1)


@dataclass
class Model:
    """Lookup tables: per feature by bin, and per pair of features by coarser bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], rows[:, f], side="right")]
        bins = {f: np.searchsorted(self.coarse[f], rows[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (f, g), table in self.pairs.items():
            total += table[bins[f], bins[g]]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between ``bins`` bins of about equally many values, fewer if values tie."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g**2 / (h + ridge)


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """Value per bin of the best tree of up to ``leaves`` leaves on summed gradients."""
    cuts = [0, len(g)]
    big_g, big_h = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            inner = np.arange(a + 1, b)
            left_g, left_h = big_g[inner] - big_g[a], big_h[inner] - big_h[a]
            right_g, right_h = big_g[b] - big_g[inner], big_h[b] - big_h[inner]
            gain = _gain(left_g, left_h, ridge) + _gain(right_g, right_h, ridge) - _gain(
                big_g[b] - big_g[a], big_h[b] - big_h[a], ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            top = int(gain.argmax())
            if gain[top] > best:
                best, at = gain[top], int(inner[top])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    values = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b] = (big_g[b] - big_g[a]) / (big_h[b] - big_h[a] + ridge)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four by one border on each side."""
    corner_g, corner_h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    total = [(c[:, -1:], c[-1:, :], c[-1, -1]) for c in (corner_g, corner_h)]
    parts = []
    for corner, (right, down, whole) in zip((corner_g, corner_h), total, strict=True):
        parts.append([corner, right - corner, down - corner, whole - right - down + corner])
    gain = sum(_gain(a, np.maximum(b, 0), ridge) for a, b in zip(*parts, strict=True))[1:-1, 1:-1]
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = (x + 1 for x in np.unravel_index(gain.argmax(), gain.shape))
    values = np.zeros_like(g)
    for rows in (slice(0, i), slice(i, None)):
        for columns in (slice(0, j), slice(j, None)):
            values[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
    return float(gain.max()), values


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    rounds: int = 150,
    pair_rounds: int = 60,
    n_pairs: int = 8,
    bins: int = 48,
    coarse_bins: int = 8,
    rate: float = 0.1,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Model:
    """Cyclic boosting: in every round each feature in turn gets one shallow tree.

    A tree sees its own feature alone and is added to that feature's table, so
    the sum of all rounds is a table again. The pairs that explain most of what
    the single features leave are then boosted in turn in the same way, on
    grids. Without rows, or with labels of one kind, the tables stay zero and
    the intercept is the smoothed share of ones.
    """
    n, width = len(rows), len(FEATURES)
    prior = (labels.sum() + 1) / (n + 2)
    edges = [_edges(rows[:, f], bins) if n else np.zeros(0) for f in range(width)]
    coarse = [_edges(rows[:, f], coarse_bins) if n else np.zeros(0) for f in range(width)]
    model = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, {})
    if n == 0 or labels.min() == labels.max():
        return model
    at = [np.searchsorted(edges[f], rows[:, f], side="right") for f in range(width)]
    logits = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
        return labels - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), ridge, least)
            model.tables[f] += step
            logits += step[at[f]]

    wide = [np.searchsorted(coarse[f], rows[:, f], side="right") for f in range(width)]

    def grid(pair: tuple[int, int], values: np.ndarray) -> np.ndarray:
        f, k = pair
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        return np.bincount(wide[f] * shape[1] + wide[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: -_quadrants(grid(p, g), grid(p, h), ridge)[0])
    for pair in ranked[:n_pairs]:
        model.pairs[pair] = np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1))
    for _ in range(pair_rounds):
        for pair, table in model.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(grid(pair, g), grid(pair, h), ridge)[1]
            table += step
            logits += step[wide[pair[0]], wide[pair[1]]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, **options: float) -> Model:
    """Fit on labelled documents outside the held-out fifth.

    Of more than ``max_rows`` distinct labels those of the smallest hashes are taken; so
    many ids at most are sent to the scan of the documents and so many rows of
    features come back, as documents that repeat an id teach once, by their smallest
    features. Null labels, ids and labels without document are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("double").alias("__label"))
        .filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
        .distinct().orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen), "__id",
    )
    vectors = F.arrow_udf(_feature_lists, "array<double>")
    each = in_batches(rows).select("__id", "__label", vectors("text").alias("features"))
    found = each.groupBy("__id", "__label").agg(F.min("features").alias("features")).collect()
    values = np.array([r["features"] for r in found], float).reshape(-1, len(FEATURES))
    targets = np.array([r["__label"] for r in found], float)
    # rows arrive in no fixed order, and sums of floats depend on it
    order = np.lexsort([*values.T, targets])
    return fit(values[order], (targets[order] > 0.5).astype(float), **options)


def _feature_lists(texts: pa.Array) -> pa.Array:
    return pa.array(list(features(texts)), pa.list_(pa.float64()))


def scorer(model: Model) -> Callable[[Column], Column]:
    """Column function: score of a text between 0 and 1."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(features(texts)))

    column = F.arrow_udf(score, "double")
    return lambda text: column(F.coalesce(text.cast("binary"), F.lit(b"")))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text, one row per input row.

    Null and empty texts are scored as empty; repeated rows and null ids stay as
    they are (a null id is not held out). Other columns are ignored.
    """
    scored = in_batches(docs).select(F.col("doc_id").cast("long"), scorer(model)(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` whose score reaches ``cutoff``, all columns kept.

    A null text is scored as empty, whole texts are read, and rows that repeat an id or a text are
    judged each for itself. Columns may have any name; an empty table stays empty.
    """
    (name,) = free_names(docs, "score")
    return in_batches(docs).withColumn(name, scorer(model)(F.col("text"))).filter(F.col(name) >= cutoff).drop(name)
