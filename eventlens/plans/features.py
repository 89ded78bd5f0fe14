"""Feature jobs: compute what is pending, append it, and score recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.operators.frames import (
    AUDIO_RATE,
    F0_MIN,
    FRAME_LENGTH,
    HOP_LENGTH,
    SAMPLE_FPS,
    every_kth_sample,
    frame_rms_stats,
    label_ratios,
    voiced_pitch_stats,
)
from eventlens.operators.scoring import KEY, score_summary
from eventlens.operators.verbal import speech_rate, verbal_features
from eventlens.plans.pitch import PitchResult, pitch_factor
from eventlens.plans.resume import pending_filter
from eventlens.sources.sinks import sink_append, sink_overwrite
from eventlens.sources.tables import read_modality

NO_PITCH_ERROR = "no pitch frames"


def vocal_features(
    pitch_frames: DataFrame,
    signal: DataFrame,
    segments: DataFrame | None = None,
    rate: float = AUDIO_RATE,
    hop: int = HOP_LENGTH,
    frame_length: int = FRAME_LENGTH,
    fmin: float = F0_MIN,
) -> DataFrame:
    """Pitch, energy, speech rate and duration per recording of ``signal``.

    The speech rate is NULL without a transcript. Each part is summed to one
    row per recording before parts are joined.
    """
    energy = frame_rms_stats(signal, rate, hop, frame_length)
    joined = energy.join(voiced_pitch_stats(pitch_frames, fmin), KEY, "left")
    if segments is None:
        joined = joined.withColumn("speech_rate", F.lit(None).cast("double"))
    else:
        joined = joined.join(speech_rate(segments), KEY, "left")
    return joined.select(
        KEY, "f0_mean", "f0_std", "rms_mean", "rms_std", "speech_rate", "duration_s",
        F.when(F.col("f0_mean").isNull(), NO_PITCH_ERROR).otherwise("").alias("error"),
    )


def run_verbal(
    segments: DataFrame,
    lexicon: DataFrame,
    output: str,
    tokenizer: str | Callable[[Column], Column] = "char",
    score: Column | None = None,
) -> None:
    """Append verbal features of new recordings."""
    pending = pending_filter(segments.sparkSession, output, [KEY])(segments)
    sink_append(verbal_features(pending, lexicon, tokenizer, score), output)


def run_visual(frame_labels: DataFrame, output: str, sample_fps: float = SAMPLE_FPS, method: str = "labels") -> None:
    """Append label ratios of new recordings."""
    pending = pending_filter(frame_labels.sparkSession, output, [KEY])(frame_labels)
    sink_append(label_ratios(every_kth_sample(pending, sample_fps), method), output)


def run_vocal(signal: DataFrame, pitch_frames: DataFrame, output: str, segments: DataFrame | None = None) -> None:
    """Append vocal features of new recordings."""
    keep = pending_filter(signal.sparkSession, output, [KEY])
    talk = None if segments is None else keep(segments)
    sink_append(vocal_features(keep(pitch_frames), keep(signal), talk), output)


def run_pitch(
    vocal: DataFrame | str,
    verbal: DataFrame | str,
    visual: DataFrame | str | None,
    output: str,
    n_components: int = 1,
) -> tuple[PitchResult, DataFrame]:
    """Score recordings from stored feature tables, write scores and summarise them.

    Tables are given as frames or as parquet paths; vocal and verbal must exist,
    a visual table whose path does not is left out.
    """

    def load(table: DataFrame | str) -> DataFrame:
        return read_modality(SparkSession.active(), table) if isinstance(table, str) else table

    try:
        seen = None if visual is None else load(visual)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        seen = None
    result = pitch_factor(load(vocal), load(verbal), seen, n_components)
    sink_overwrite(result.scores, output)
    return result, score_summary(result.scores)
