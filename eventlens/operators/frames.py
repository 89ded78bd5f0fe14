"""Measures of audio frames and of labelled video frames."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventlens.functions.labels import label_class
from eventlens.functions.nulls import number, ratio
from eventlens.session import settle

# Sampling and framing defaults.
AUDIO_RATE = 16_000
HOP_LENGTH = 512
FRAME_LENGTH = 2048
F0_MIN = 50.0
SAMPLE_FPS = 1.0
DEFAULT_FPS = 25.0


def voiced_pitch_stats(frames: DataFrame, fmin: float = F0_MIN) -> DataFrame:
    """Mean and population deviation of pitch over frames above ``fmin``; 0 without any.

    A NaN pitch is an unvoiced frame.
    """
    pitch = number(F.col("f0"))
    voiced = F.when(pitch > fmin, pitch)
    return frames.groupBy("file_stem").agg(
        F.coalesce(F.avg(voiced), F.lit(0.0)).alias("f0_mean"),
        F.coalesce(F.stddev_pop(voiced), F.lit(0.0)).alias("f0_std"),
    )


def frame_rms_stats(
    signal: DataFrame,
    rate: float = AUDIO_RATE,
    hop: int = HOP_LENGTH,
    frame_length: int = FRAME_LENGTH,
    center: bool = True,
) -> DataFrame:
    """Mean and population deviation of frame RMS, and the duration, per clip.

    Frame f covers ``frame_length`` samples from ``f * hop``, moved back by half
    a frame when ``center`` is set; samples outside the clip count as zero.
    Samples are summed to blocks of the common divisor of hop and frame before
    the shuffle, and a frame is put together from two running sums of blocks:
    overlapping frames never multiply the samples, whatever the divisor.
    Blocks are stored, so the samples are read once.

    Expects ``file_stem, sample_idx, x``; ``x`` may be an array of consecutive
    samples from ``sample_idx`` on, which saves a row per sample. NaN counts as
    no sample value.
    """
    if dict(signal.dtypes)["x"].startswith("array"):
        chunks = signal.select("file_stem", "sample_idx", F.posexplode("x").alias("pos", "x"))
        signal = chunks.withColumn("sample_idx", F.col("sample_idx") + F.col("pos"))
    pad = frame_length // 2 if center else 0
    block = gcd(gcd(hop, frame_length), pad) if pad else gcd(hop, frame_length)
    x = number(F.col("x"))
    summed = signal.groupBy(
        "file_stem", F.floor(F.col("sample_idx") / block).alias("block")
    ).agg(F.sum(x * x).alias("energy"), F.count(F.lit(1)).alias("samples"))
    blocks = settle(summed, "blocks")
    lengths = blocks.groupBy("file_stem").agg(F.sum("samples").alias("n"))
    energies = _frame_energies(blocks, block, hop, frame_length, pad)
    last_frame = F.floor((F.col("n") + 2 * pad - frame_length) / hop)
    rms = F.when(F.col("frame") <= last_frame, F.sqrt(F.col("energy") / frame_length))
    # an inner join, so that a clip with most of the frames can be split
    stats = energies.join(lengths, "file_stem").groupBy("file_stem").agg(
        F.avg(rms).alias("rms_mean"),
        F.stddev_pop(rms).alias("rms_std"),
        (F.max("n") / F.lit(float(rate))).alias("duration_s"),
    )
    if center:
        return stats
    # without padding a clip shorter than a frame has none
    all_clips = lengths.select("file_stem", (F.col("n") / F.lit(float(rate))).alias("duration_s"))
    return all_clips.join(stats.drop("duration_s"), "file_stem", "left").select(*stats.columns)


def _frame_energies(blocks: DataFrame, block: int, hop: int, frame_length: int, pad: int) -> DataFrame:
    """``file_stem, frame, energy`` of each frame that has a block, from ``file_stem, block, energy``.

    Blocks are cut into chunks as long as a frame. A frame is then the end of
    one chunk and the beginning of the next, or one whole chunk: a running sum
    from behind and one from the front, added and never subtracted, so that quiet frames keep their
    digits beside loud ones. Each frame takes at most one row of either, and a task
    orders no more than the blocks of a chunk.
    """
    width = frame_length // block
    chunked = blocks.select("file_stem", "block", "energy", F.floor(F.col("block") / width).alias("chunk"))
    front = Window.partitionBy("file_stem", "chunk").orderBy("block")
    behind = Window.partitionBy("file_stem", "chunk").orderBy(F.col("block").desc())
    so_far = lambda order: F.sum("energy").over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = chunked.select(
        "file_stem", "block", so_far(behind).alias("to_end"), so_far(front).alias("from_start"),
        # where blocks are absent, their frames begin at the next block and end at the last one before
        F.coalesce(F.lag("block").over(front), F.col("chunk") * width - 1).alias("previous"),
        F.coalesce(F.lead("block").over(front), (F.col("chunk") + 1) * width - 1).alias("following"),
    )

    def numbers(after: Column, last: Column, shift: int) -> Column:
        """Frames whose edge, ``shift`` after their start, lies behind block ``after`` and at ``last`` at most."""
        at = lambda edge: F.floor((edge * block + pad - shift) / F.lit(hop))
        low, high = F.greatest(at(after) + 1, F.lit(0)), at(last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    part = lambda frames, value: F.transform(frames, lambda f: F.struct(f.alias("frame"), F.col(value).alias("energy")))
    begins = part(numbers(F.col("previous"), F.col("block"), 0), "to_end")
    ends = part(numbers(F.col("block"), F.col("following"), frame_length), "from_start")
    each = summed.select("file_stem", F.explode(F.concat(begins, ends)).alias("p")).select("file_stem", "p.*")
    return each.groupBy("file_stem", "frame").agg(F.sum("energy").alias("energy"))


def sample_interval(fps: Column, sample_fps: float = SAMPLE_FPS) -> Column:
    """Frames between two samples, at least 1; a half is rounded to even."""
    usable = F.when(fps > 0, fps).otherwise(F.lit(DEFAULT_FPS))
    return F.greatest(F.lit(1), F.bround(usable / F.lit(float(sample_fps))).cast("bigint"))


def every_kth_sample(frames: DataFrame, sample_fps: float = SAMPLE_FPS) -> DataFrame:
    """Frames whose number is a multiple of the clip's sampling interval."""
    return frames.where(F.pmod(F.col("frame_idx"), sample_interval(F.col("fps"), sample_fps)) == 0)


def label_ratios(frames: DataFrame, method: str = "labels") -> DataFrame:
    """Shares of positive, negative and neutral frames among frames with a label.

    The label column is ``emotion``; it is NULL on a frame without a face.
    Ratios are NULL when no frame of the clip has a label.
    """
    polarity = label_class(F.col("emotion"))
    classes = ("positive", "negative", "neutral")
    counted = frames.groupBy("file_stem").agg(
        F.count(F.lit(1)).alias("frames_analyzed"),
        F.count(polarity).alias("frames_with_face"),
        *[F.count_if(polarity == c).alias(f"{c}_n") for c in classes],
    )
    face = F.col("frames_with_face")
    shares = {c: ratio(F.col(f"{c}_n"), face) for c in classes}
    return counted.select(
        "file_stem",
        *[share.alias(f"{c}_ratio") for c, share in shares.items()],
        (shares["positive"] - shares["negative"]).alias("net_positive"),
        "frames_analyzed",
        "frames_with_face",
        F.lit(method).alias("method"),
        F.lit("").alias("error"),
    )
