"""Measures of transcript text.

All of them work on segment rows ``file_stem, seg_no, start, end, text`` and
add up per recording, so a long recording is never assembled in one place.
A recording without segments is one row whose ``seg_no`` is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.guarded import guarded
from eventlens.functions.nulls import ratio
from eventlens.functions.text import strip, tokens
from eventlens.session import broadcast_within

CATEGORIES = ("positive", "negative", "uncertainty")
# Fixed values of the result columns.
EMPTY_TEXT_ERROR = "转录文本为空"
LEXICON_METHOD = "lexicon"
POLARITY_METHOD = "snownlp"


def lexicon_flags(lexicon: DataFrame) -> DataFrame:
    """One row per word with a flag per category, so that a join never fans out."""
    return lexicon.groupBy("word").agg(
        *[F.bool_or(F.col("category") == c).alias(c) for c in CATEGORIES]
    )


def _flagged_tokens(
    segments: DataFrame, flags: DataFrame, tokenizer: str | Callable[[Column], Column]
) -> DataFrame:
    """Tokens of every segment with lexicon flags; at least one row per segment.

    ``chars`` is carried by the first row of a segment only. With the lexicon
    broadcast the tokens stay in their task until they are summed.
    """
    text = F.coalesce("text", F.lit(""))
    chars = F.length(F.replace(strip(text), F.lit(" "), F.lit("")))
    exploded = segments.select(
        "file_stem", chars.alias("chars"), F.posexplode_outer(tokens(text, tokenizer)).alias("pos", "word")
    ).select("file_stem", "word", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("chars")).alias("chars"))
    return exploded.join(flags, "word", "left")


def _tone_sums() -> list[Column]:
    return [
        F.count("word").alias("total_words"),
        *[F.count_if(F.col(c)).alias(f"{c}_n") for c in CATEGORIES],
    ]


def _tone_ratios() -> list[Column]:
    total = F.col("total_words")

    def share(count: Column) -> Column:
        return F.coalesce(ratio(count, total), F.lit(0.0))

    return [
        share(F.col("positive_n")).alias("positive_ratio"),
        share(F.col("negative_n")).alias("negative_ratio"),
        share(F.col("uncertainty_n")).alias("uncertain_ratio"),
        share(F.col("positive_n") - F.col("negative_n")).alias("tone_score"),
    ]


def lexicon_tone(
    segments: DataFrame, lexicon: DataFrame, tokenizer: str | Callable[[Column], Column] = "char"
) -> DataFrame:
    """Category shares and tone per recording; all 0.0 when it has no token."""
    summed = (
        _flagged_tokens(segments, broadcast_within(lexicon_flags(lexicon)), tokenizer)
        .groupBy("file_stem").agg(*_tone_sums())
    )
    return summed.select("file_stem", *_tone_ratios(), "total_words", F.lit(LEXICON_METHOD).alias("method"))


def _polarity(avg_score: Column, n: Column) -> list[Column]:
    tone = (F.coalesce(avg_score, F.lit(0.5)) - 0.5) * 2
    return [
        F.greatest(F.lit(0.0), tone).alias("positive_ratio"),
        F.greatest(F.lit(0.0), -tone).alias("negative_ratio"),
        F.lit(None).cast("double").alias("uncertain_ratio"),
        tone.alias("tone_score"),
        n.alias("total_words"),
    ]


def polarity_tone(
    segments: DataFrame, score: Column, method: str = POLARITY_METHOD
) -> DataFrame:
    """Tone from a score in [0, 1] per segment, 0 without any score.

    ``score`` is any column expression, such as a pandas UDF over ``text``.
    Blank segments and NULL scores are left out.
    """
    kept = F.when(strip(F.coalesce("text", F.lit(""))) != "", score)
    summed = segments.groupBy("file_stem").agg(F.avg(kept).alias("s"), F.count(kept).alias("n"))
    return summed.select("file_stem", *_polarity(F.col("s"), F.col("n")), F.lit(method).alias("method"))


def guarded_polarity(
    segments: DataFrame, score: Callable[[pd.Series], pd.Series], method: str = POLARITY_METHOD
) -> DataFrame:
    """:func:`polarity_tone` by a scorer over texts that may fail: failing segments are left out and counted.

    Adds ``errors``, the number of segments whose scoring raised, and ``error``,
    the first of their messages in the order of text, else empty.
    """
    scored = segments.select("file_stem", "text", guarded(score)(F.col("text")).alias("scored"))
    spoken = strip(F.coalesce("text", F.lit(""))) != ""
    kept = F.when(spoken, F.col("scored.value"))
    failed = F.when(spoken, F.col("scored.error"))
    summed = scored.groupBy("file_stem").agg(
        F.avg(kept).alias("s"), F.count(kept).alias("n"), F.count(failed).alias("errors"), F.coalesce(F.min(failed), F.lit("")).alias("error"),
    )
    return summed.select("file_stem", *_polarity(F.col("s"), F.col("n")), F.lit(method).alias("method"), "errors", "error")


def verbal_features(
    segments: DataFrame,
    lexicon: DataFrame,
    tokenizer: str | Callable[[Column], Column] = "char",
    score: Column | None = None,
) -> DataFrame:
    """All verbal columns per recording, with an error text for blank transcripts.

    The lexicon is used unless it is empty; the polarity score is then used
    instead. Counting characters and tokens is one pass with one shuffle. The
    lexicon is stored first, so that looking whether it is empty and joining it
    compute it once.
    """
    flags = broadcast_within(lexicon_flags(lexicon))
    measures = ["positive_ratio", "negative_ratio", "uncertain_ratio", "tone_score"]
    if not flags.isEmpty():
        summed = (
            _flagged_tokens(segments, flags, tokenizer)
            .groupBy("file_stem")
            .agg(*_tone_sums(), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"))
            .select("file_stem", *_tone_ratios(), "total_words", "total_chars")
        )
        method = LEXICON_METHOD
    else:
        if score is None:
            raise ValueError("the lexicon is empty and no polarity score is given")
        body = strip(F.coalesce("text", F.lit("")))
        kept = F.when(body != "", score)
        summed = (
            segments.groupBy("file_stem")
            .agg(
                F.avg(kept).alias("s"),
                F.count(kept).alias("n"),
                F.coalesce(F.sum(F.length(F.replace(body, F.lit(" "), F.lit("")))), F.lit(0)).alias("total_chars"),
            )
            .select("file_stem", *_polarity(F.col("s"), F.col("n")), "total_chars")
        )
        method = POLARITY_METHOD
    spoken = F.col("total_chars") > 0
    return summed.select(
        "file_stem",
        *[F.when(spoken, F.col(c)).alias(c) for c in measures],
        F.when(spoken, F.col("total_words")).otherwise(0).alias("total_words"),
        "total_chars",
        F.when(spoken, method).otherwise("").alias("method"),
        F.when(spoken, "").otherwise(EMPTY_TEXT_ERROR).alias("error"),
    )


def speech_rate(segments: DataFrame) -> DataFrame:
    """Characters per second of speech; NULL without segments or duration."""
    zero = F.lit(0.0)
    seconds = F.greatest(zero, F.coalesce("end", zero) - F.coalesce("start", zero))
    chars = F.length(strip(F.coalesce("text", F.lit(""))))
    summed = segments.groupBy("file_stem").agg(F.sum(chars).alias("chars"), F.sum(seconds).alias("seconds"))
    return summed.select(
        "file_stem",
        F.when(F.col("seconds") > 0, ratio(F.col("chars"), F.col("seconds"))).alias("speech_rate"),
    )
