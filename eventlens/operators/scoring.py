"""Feature matrix, imputation, standardising and principal components.

What reaches the driver is a few numbers per feature, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features taken from each modality.
VOCAL_FEATURES = ["f0_mean", "f0_std", "rms_mean", "rms_std", "speech_rate"]
VERBAL_FEATURES = ["positive_ratio", "negative_ratio", "uncertain_ratio", "tone_score"]
VISUAL_FEATURES = ["positive_ratio", "negative_ratio", "net_positive"]
KEY = "file_stem"


def modality_columns(df: DataFrame, prefix: str, wanted: list[str]) -> DataFrame:
    """Key and the wanted columns that exist, with a prefix on their names."""
    present = [c for c in wanted if c in df.columns]
    return df.select(KEY, *[F.col(c).alias(f"{prefix}{c}") for c in present])


def repeated_keys(df: DataFrame) -> DataFrame:
    """Keys that occur more than once; joining such a table multiplies rows."""
    return df.groupBy(KEY).count().where(F.col("count") > 1)


def modality_join(
    vocal: DataFrame, verbal: DataFrame, visual: DataFrame | None = None, min_vocal: bool = True
) -> DataFrame:
    """Feature matrix of all modalities, features prefixed by modality.

    Recordings need both vocal and verbal rows, or either one when
    ``min_vocal`` is off. Visual features are optional.
    """
    left = modality_columns(vocal, "vocal_", VOCAL_FEATURES)
    right = modality_columns(verbal, "verbal_", VERBAL_FEATURES)
    merged = left.join(right, KEY, "inner" if min_vocal else "outer")
    if visual is None:
        return merged
    return merged.join(modality_columns(visual, "visual_", VISUAL_FEATURES), KEY, "left")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != KEY]


@dataclass(frozen=True)
class FeatureStats:
    """Number of values, mean and population deviation of a feature."""

    count: int
    mean: float | None
    std: float | None


def feature_stats(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, FeatureStats]]:
    """Row count and statistics of every feature in one aggregation."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        measures += [
            F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"),
        ]
    row = df.agg(*measures).first()
    stats = {c: FeatureStats(row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    return row["rows"], stats


def mean_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace NULL by the column mean; an all-NULL column stays NULL."""
    _, stats = feature_stats(df, columns)
    return df.select(
        *[
            F.coalesce(F.col(c), F.lit(stats[c].mean).cast("double")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def _scaled(value: Column, mean: float | None, std: float | None) -> Column:
    """Centred and divided by the deviation, by 1 if that is 0."""
    return (value - F.lit(mean).cast("double")) / F.lit(std or 1.0)


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre and divide by the population deviation, or by 1 if that is 0."""
    _, stats = feature_stats(df, columns)
    return df.select(
        *[
            _scaled(F.col(c), stats[c].mean, stats[c].std).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Drop all-NULL features, impute means and standardise, from one pass.

    Filling in the mean leaves it unchanged and spreads the sum of squares
    over all rows, so statistics of the present values are enough.
    """
    rows, stats = feature_stats(df, columns)
    kept = [c for c in columns if stats[c].count > 0]

    def column(c: str) -> Column:
        s = stats[c]
        std = s.std * (s.count / rows) ** 0.5
        return _scaled(F.coalesce(F.col(c), F.lit(s.mean)), s.mean, std).alias(c)

    return df.select(KEY, *[column(c) for c in kept]), kept


@dataclass(frozen=True)
class Components:
    """Loadings per component (one list each) and shares of variance explained."""

    features: list[str]
    loadings: list[list[float]]
    ratios: list[float]


def _oriented(vector: list[float]) -> list[float]:
    """Turn a component so that its largest loading is positive (first on ties)."""
    top = max(abs(v) for v in vector)
    lead = next(v for v in vector if abs(v) >= top - 1e-9)
    return [-v for v in vector] if lead < 0 else list(vector)


def fit_components(scaled: DataFrame, columns: list[str], n_components: int = 1) -> Components:
    """Principal components of standardised features."""
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(scaled).select("v")
    model = PCA(k=n_components, inputCol="v", outputCol="s").fit(vectors)
    matrix = model.pc.toArray()
    loadings = [_oriented([float(v) for v in matrix[:, i]]) for i in range(n_components)]
    return Components(columns, loadings, [float(v) for v in model.explainedVariance])


def component_scores(scaled: DataFrame, fit: Components) -> DataFrame:
    """``pitch_factor`` (the first component) and ``pc1..`` per recording."""

    def score(weights: list[float]) -> Column:
        terms = [F.col(c) * F.lit(w) for c, w in zip(fit.features, weights)]
        return reduce(lambda a, b: a + b, terms)

    scores = [score(w).alias(f"pc{i}") for i, w in enumerate(fit.loadings, 1)]
    return scaled.select(KEY, *scores).select(
        KEY, F.col("pc1").alias("pitch_factor"), *[f"pc{i}" for i in range(1, len(scores) + 1)]
    )


def loadings_table(scaled: DataFrame, fit: Components) -> DataFrame:
    """Feature by component, in descending order of the first component."""
    names = [f"pc{i}" for i in range(1, len(fit.loadings) + 1)]
    rows = [(f, *[w[j] for w in fit.loadings]) for j, f in enumerate(fit.features)]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return scaled.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("pc1"))


def variance_table(scaled: DataFrame, fit: Components) -> DataFrame:
    """Share of variance explained per component, and its running total."""
    rows, total = [], 0.0
    for i, share in enumerate(fit.ratios, 1):
        total += share
        rows.append((f"pc{i}", share, total))
    return scaled.sparkSession.createDataFrame(
        rows, "component string, explained_variance_ratio double, cumulative_ratio double"
    )


def score_summary(scores: DataFrame, column: str = "pitch_factor") -> DataFrame:
    """Number, mean, sample deviation, minimum and maximum of a score."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
