"""Emotion labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label spellings and the polarity of each label.
LABEL_ALIASES = {"anger": "angry", "sadness": "sad", "happiness": "happy"}
POSITIVE_LABELS = ["happy", "surprise"]
NEGATIVE_LABELS = ["angry", "fear", "disgust", "sad"]


def normalise_label(label: Column) -> Column:
    """Lower-case label with alternative spellings unified."""
    lowered = F.lower(label)
    unified = lowered
    for alias, name in LABEL_ALIASES.items():
        unified = F.when(lowered == alias, name).otherwise(unified)
    return unified


def label_class(label: Column) -> Column:
    """``positive``, ``negative`` or ``neutral``; NULL without a label."""
    name = normalise_label(label)
    return (
        F.when(name.isin(POSITIVE_LABELS), "positive")
        .when(name.isin(NEGATIVE_LABELS), "negative")
        .when(name.isNotNull(), "neutral")
    )
