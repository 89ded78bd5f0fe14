"""The recording score from the feature tables of the modalities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from eventlens.operators.scoring import (
    KEY,
    Components,
    component_scores,
    feature_columns,
    fit_components,
    modality_join,
    repeated_keys,
    standardised,
)
from eventlens.session import settle


@dataclass(frozen=True)
class PitchResult:
    scores: DataFrame
    scaled: DataFrame
    fit: Components


def require_unique(merged: DataFrame) -> None:
    """Raise when a recording occurs twice; its rows would be weighted twice.

    A recording repeated in one modality is repeated in the joined table.
    """
    repeated = repeated_keys(merged).limit(1).collect()
    if repeated:
        raise ValueError(f"a modality holds {repeated[0][KEY]!r} more than once")


def pitch_factor(
    vocal: DataFrame,
    verbal: DataFrame,
    visual: DataFrame | None = None,
    n_components: int = 1,
    min_vocal: bool = True,
    check_unique: bool = True,
) -> PitchResult:
    """Join, impute, standardise and score recordings by principal components.

    The joined table has one short row per recording and is read several
    times, so it is stored first.
    """
    merged = settle(modality_join(vocal, verbal, visual, min_vocal), "features")
    if check_unique:
        require_unique(merged)
    scaled, kept = standardised(merged, feature_columns(merged))
    fit = fit_components(scaled, kept, n_components)
    return PitchResult(component_scores(scaled, fit), scaled, fit)
