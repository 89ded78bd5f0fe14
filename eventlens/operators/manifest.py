"""Media manifests: which file belongs to which event, and which segments to join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.text import path_stem, strip
from eventlens.sources.sinks import sink_counted

# Platforms in order of preference, and column and file name parts.
PLATFORMS = ["全景", "上证", "中国证券网", "中证", "IR"]
INDEX_SUFFIXES = {"code": "去重代码", "date": "日期", "video_number": "视频数量"}
SEGMENT_MARK = "_视频"
PROMO_MARK = "宣传片"


@dataclass(frozen=True)
class SegmentRule:
    """Numbered segments taken for a platform, up to ``max_segment``.

    ``codes`` limits the rule to some securities. ``expected`` is the number of
    segments that should be found; None means the number of videos, at most
    ``max_segment``.
    """

    platform: str
    max_segment: int
    ascending: bool = True
    min_videos: int = 0
    codes: tuple[str, ...] | None = None
    expected: int | None = None


# Platforms and securities whose recordings come in segments.
# A later rule takes precedence. Listed securities of 中证 are played backwards;
# others of it with several videos get no segment.
SEGMENT_RULES = (
    SegmentRule("上证", 2),
    SegmentRule("中国证券网", 2),
    SegmentRule("中证", 0, ascending=False, min_videos=2, expected=2),
    SegmentRule("中证", 2, ascending=False, min_videos=2, codes=("301161",), expected=2),
    SegmentRule(
        "中证", 3, ascending=False, min_videos=2, expected=3,
        codes=("001217", "301000", "301022", "301093", "301149", "301180", "301230"),
    ),
)


def platform_pick(index: DataFrame, platforms: list[str] = PLATFORMS) -> DataFrame:
    """Code, date and number of videos from the columns of each row's own platform.

    Rows without a platform are dropped. Columns are named
    ``{platform}_{suffix}``; where one is absent or empty the code and the date
    are empty text and the number of videos is 1.
    """

    def picked(suffix: str) -> Column:
        names = [(p, f"{p}_{suffix}") for p in platforms]
        cases = [
            F.when(F.col("platform") == p, strip(F.col(name))) for p, name in names if name in index.columns
        ]
        return F.coalesce(*cases, F.lit(None).cast("string"))

    chosen = index.where(F.col("platform").isNotNull()).withColumn("platform", strip(F.col("platform")))
    return chosen.select(
        strip(F.coalesce("index2009", F.lit(""))).alias("index2009"),
        "platform",
        F.coalesce(picked(INDEX_SUFFIXES["code"]), F.lit("")).alias("code"),
        F.coalesce(picked(INDEX_SUFFIXES["date"]), F.lit("")).alias("date"),
        F.coalesce(picked(INDEX_SUFFIXES["video_number"]).try_cast("int"), F.lit(1)).alias("video_number"),
    )


def media_name(extension: str) -> Column:
    """Expected file name ``{index}_{code}_{date}.{extension}``."""
    return F.concat(F.concat_ws("_", "index2009", "code", "date"), F.lit(f".{extension}"))


def manifest_check(manifest: DataFrame, files: DataFrame, extension: str = "wav") -> DataFrame:
    """Expected file of every event with its path, NULL when it is missing."""
    found = files.groupBy("name").agg(F.min("path").alias("audio_path"))
    expected = manifest.select("index2009", media_name(extension).alias("name"))
    return expected.join(found, "name", "left").select("index2009", "name", "audio_path")


def manifest_counts(checked: DataFrame, path_col: str = "audio_path") -> DataFrame:
    """Number of events and of those whose file exists."""
    return checked.agg(F.count(F.lit(1)).alias("total"), F.count(path_col).alias("valid"))


def write_manifest(checked: DataFrame, path: str, path_col: str = "audio_path") -> dict[str, int]:
    """Write a checked manifest and give :func:`manifest_counts` of it, counted by the writing itself."""
    return sink_counted(checked, path, total=F.count(F.lit(1)), valid=F.count(path_col))


def priority_lookup(
    items: DataFrame, files: DataFrame, platforms: list[str] = PLATFORMS
) -> DataFrame:
    """Path of the file of the same stem on the first platform that has one.

    ``items`` has ``file_stem``, ``files`` has ``platform, path``. Items without
    a file keep a NULL path.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in platforms]), F.col("platform"))
    ranked = files.select(path_stem(F.col("path")).alias("file_stem"), "path", rank.alias("rank"))
    best = (
        ranked.where(F.col("rank") > 0)
        .groupBy("file_stem")
        .agg(F.min(F.struct("rank", "path")).alias("best"))
        .select("file_stem", F.col("best.path").alias("path"))
    )
    return items.join(best, "file_stem", "left")


def _by_rule(rules: tuple[SegmentRule, ...], value, default: Column) -> Column:
    chosen = default
    for rule in rules:
        applies = (F.col("platform") == rule.platform) & (F.col("video_number") >= rule.min_videos)
        if rule.codes is not None:
            applies = applies & F.col("code").isin(*rule.codes)
        chosen = F.when(applies, value(rule)).otherwise(chosen)
    return chosen


def _expected(rule: SegmentRule) -> Column:
    if rule.expected is not None:
        return F.lit(rule.expected)
    return F.least(F.lit(rule.max_segment), F.col("video_number"))


# Characters of a date that name files are met by; a shorter date meets all files of its code.
_DATE_KEY = 8


def _candidates(lookups: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of the code of each lookup in whose name the beginning of its date follows a ``_``.

    What follows each ``_`` is taken with any further ``_`` in it, since a date may have some.
    Without a date of full length, such as on the platform that has none, only
    platform and code are compared.
    """
    parts = F.split("name", "_")
    after = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda n: F.substring(F.array_join(F.slice(parts, n, F.size(parts)), "_"), 1, _DATE_KEY),
    )
    keyed = listed.withColumn("day", F.explode(F.array_distinct(after)))
    long = F.length("date") >= _DATE_KEY
    by_day = lookups.where(long).withColumn("day", F.substring("date", 1, _DATE_KEY))
    found = by_day.join(keyed, ["platform", "code", "day"]).drop("day")
    return found.unionByName(lookups.where(~long).join(listed, ["platform", "code"]))


def segment_plan(
    manifest: DataFrame, files: DataFrame, rules: tuple[SegmentRule, ...] = SEGMENT_RULES
) -> DataFrame:
    """Files to be joined per event, in order, with what was expected and found.

    ``files`` has ``platform, path, name`` with names
    ``{code}_{title}_{date}_视频{n}*.mp4``. Events under a rule take segments
    1 to its maximum; others take one file that is not a promotion. Of
    several files with one number, or several candidates, the first path is
    taken. ``status`` is ``ok``, ``mismatch`` or ``missing``.
    """
    keys = ["index2009", "platform", "code", "date", "video_number"]
    none = F.lit(None)
    tasks = manifest.select(
        *keys,
        _by_rule(rules, lambda r: F.lit(r.max_segment), none.cast("int")).alias("max_segment"),
        _by_rule(rules, lambda r: F.lit(r.ascending), F.lit(True)).alias("ascending"),
        _by_rule(rules, _expected, F.lit(1)).alias("expected"),
    ).dropDuplicates(keys)
    listed = files.select(
        "platform",
        F.substring_index("name", "_", 1).alias("code"),
        "path",
        "name",
        F.regexp_extract("name", f"{SEGMENT_MARK}(\\d+)", 1).alias("segment_text"),
    ).where(F.col("name").endswith(".mp4"))
    # what is found depends on these alone, so events that share them are looked up once
    lookup_keys = ["platform", "code", "date", "top"]
    lookups = tasks.select("platform", "code", "date", F.coalesce("max_segment", F.lit(-1)).alias("top")).distinct()
    joined = _candidates(lookups, listed)
    # what follows "{code}_" must hold "_{date}", for segments right before the mark
    rest = F.col("name").substr(F.length("code") + 2, F.length("name"))
    dated = F.concat(F.lit("_"), F.col("date"))
    number = F.col("segment_text").try_cast("int")
    is_segment = (
        F.contains(rest, F.concat(dated, F.lit(SEGMENT_MARK)))
        & (number.cast("string") == F.col("segment_text"))
        & number.between(1, F.col("top"))
    )
    is_single = F.contains(rest, dated) & ~F.contains("name", F.lit(PROMO_MARK))
    slot = F.when(F.col("top") < 0, F.when(is_single, 1)).otherwise(F.when(is_segment, number))
    # one row per lookup and segment number, so at most max_segment rows are listed
    slots = (
        joined.withColumn("slot", slot).where("slot IS NOT NULL")
        .groupBy(*lookup_keys, "slot").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("candidates"))
    )
    listings = slots.groupBy(*lookup_keys).agg(
        F.sort_array(F.collect_list(F.struct("slot", "path"))).alias("parts"), F.sum("candidates").alias("candidates")
    )
    planned = (
        tasks.withColumn("top", F.coalesce("max_segment", F.lit(-1))).join(listings, lookup_keys, "left")
        .withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<slot:int,path:string>>")))
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("bigint"))
    )
    ordered = F.when(F.col("ascending"), F.col("parts")).otherwise(F.reverse("parts"))
    found = F.when(F.col("max_segment").isNull(), F.col("candidates")).otherwise(F.size("parts"))
    return planned.select(
        *keys,
        F.transform(ordered, lambda part: part["path"]).alias("paths"),
        "expected",
        found.cast("int").alias("found"),
        "candidates",
        F.when(F.size("parts") == 0, "missing")
        .when(found != F.col("expected"), "mismatch")
        .otherwise("ok")
        .alias("status"),
    )
