"""Queries of media manifests, over pages as recordings of five platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.catalog import fixtures as fx
from eventlens.catalog.registry import query
from eventlens.operators import manifest
from eventlens.session import scratch_path
from eventlens.sources import media, tables

PLATFORMS = manifest.PLATFORMS
# Securities of the segmented platform; the last one has no rule.
_LISTED = ["001217", "301000", "301022", "301093", "301149", "301180", "301230", "301161", "300999"]


def _platform() -> Column:
    names = F.array(*[F.lit(p) for p in PLATFORMS])
    return F.element_at(names, (F.col("page_id") % 5 + 1).cast("int"))


def _code() -> Column:
    listed = F.array(*[F.lit(c) for c in _LISTED])
    k = F.floor(F.col("page_id") / 5)
    picked = F.element_at(listed, (k % len(_LISTED) + 1).cast("int"))
    return F.when(F.col("page_id") % 5 == 3, picked).otherwise((F.col("page_id") + 600000).cast("string"))


def _pages(spark: SparkSession, d: str, spelt: bool = False) -> DataFrame:
    date = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("page_id") / 5).cast("int"))
    day = F.date_format(date, "yyyyMMdd")
    if spelt:
        n = F.col("page_id") % 3
        day = F.when(n == 0, F.date_format(date, "yyyy_MM_dd")).when(n == 1, F.date_format(date, "yyyy-MM-dd")).otherwise(day)
    return fx.table(spark, d, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("P"), "page_id").alias("index2009"),
        _platform().alias("platform"),
        _code().alias("code"),
        day.alias("date"),
        (F.length("url") % 4).alias("videos"),
    )


def _index(spark: SparkSession, d: str, spelt: bool = False) -> DataFrame:
    """One row per page with code and date columns of every platform but the last."""
    pages = _pages(spark, d, spelt)
    columns = []
    for p in PLATFORMS[:-1]:
        own = F.col("platform") == p
        columns += [
            F.when(own, F.concat(F.lit(" "), "code")).otherwise("other").alias(f"{p}_去重代码"),
            F.when(own, F.col("date")).otherwise("19000101").alias(f"{p}_日期"),
            F.when(own & (F.col("videos") > 0), F.col("videos").cast("string")).alias(f"{p}_视频数量"),
        ]
    shown = F.when(F.col("page_id") % 11 != 0, F.concat("platform", F.lit(" "))).alias("platform")
    return pages.select("index2009", shown, *columns)


_SQL_PAGES = f"""pg AS (
  SELECT page_id, url, 'P' || page_id AS index2009,
    [{', '.join(f"'{p}'" for p in PLATFORMS)}][page_id % 5 + 1] AS platform,
    CASE WHEN page_id % 5 = 3 THEN [{', '.join(f"'{c}'" for c in _LISTED)}][(page_id // 5) % {len(_LISTED)} + 1]
      ELSE CAST(page_id + 600000 AS VARCHAR) END AS code,
    strftime(DATE '2020-01-01' + CAST(page_id // 5 AS INTEGER), '%Y%m%d') AS date,
    length(url) % 4 AS videos FROM pages)"""
_SQL_TASKS = f"""{_SQL_PAGES}, task AS (
  SELECT index2009, platform, CASE WHEN platform = 'IR' THEN '' ELSE code END AS code,
    CASE WHEN platform = 'IR' THEN '' ELSE date END AS date,
    CAST(CASE WHEN platform <> 'IR' AND videos > 0 THEN videos ELSE 1 END AS INTEGER) AS video_number
  FROM pg WHERE page_id % 11 <> 0)"""


@query(f"WITH {_SQL_TASKS} SELECT * FROM task")
def platform_pick(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "media_sheet")
    headers = {name: header for header, name in tables.MEDIA_HEADERS.items()}
    _index(spark, d).withColumnsRenamed(headers).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return manifest.platform_pick(tables.read_sheet(spark, path, tables.MEDIA_HEADERS))


def _audio(spark: SparkSession, d: str) -> DataFrame:
    """Audio files of two thirds of the pages, some of them listed in two folders."""
    pages = _pages(spark, d).where(F.col("page_id") % 3 != 0)
    name = F.concat_ws("_", "index2009", "code", "date")
    folders = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c")))
    named = pages.select(F.concat(name, F.lit(".wav")).alias("name"), F.explode(folders).alias("folder"))
    return named.select("name", F.concat(F.lit("/audio/"), "folder", F.lit("/"), "name").alias("path"))


@query(f"""WITH {_SQL_TASKS}, f AS (
  SELECT index2009 || '_' || code || '_' || date || '.wav' AS name, CASE WHEN page_id % 4 = 0 THEN 'a' ELSE 'c' END AS folder
  FROM pg WHERE page_id % 3 <> 0)
SELECT index2009, index2009 || '_' || code || '_' || date || '.wav' AS name, '/audio/' || folder || '/' || f.name AS audio_path
FROM task LEFT JOIN f ON f.name = index2009 || '_' || code || '_' || date || '.wav'""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    picked = manifest.platform_pick(_index(spark, d))
    return manifest.manifest_check(picked, _audio(spark, d))


@query(f"""WITH {_SQL_TASKS}, f AS (
  SELECT DISTINCT index2009 || '_' || code || '_' || date || '.wav' AS name FROM pg WHERE page_id % 3 <> 0)
SELECT count(*) AS total, count(f.name) AS valid
FROM task LEFT JOIN f ON f.name = index2009 || '_' || code || '_' || date || '.wav'""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    checked = manifest.manifest_check(manifest.platform_pick(_index(spark, d)), _audio(spark, d))
    return manifest.manifest_counts(checked)


@query(f"""WITH {_SQL_TASKS}, f AS (
  SELECT DISTINCT index2009 || '_' || code || '_' || date || '.wav' AS name FROM pg WHERE page_id % 3 <> 0)
SELECT count(*) AS total, count(f.name) AS valid, count(*) AS stored
FROM task LEFT JOIN f ON f.name = index2009 || '_' || code || '_' || date || '.wav'""")
def manifest_written(spark: SparkSession, d: str) -> DataFrame:
    """The counts that writing a manifest gives, beside the rows it stored."""
    path = scratch_path(spark, "manifest")
    counts = manifest.write_manifest(manifest.manifest_check(manifest.platform_pick(_index(spark, d)), _audio(spark, d)), path)
    told = [F.lit(counts[c]).cast("long").alias(c) for c in ("total", "valid")]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored")).select(*told, "stored")


@query(f"""WITH {_SQL_PAGES}, f AS (
  SELECT 'C' || (page_id % 97) AS file_stem, platform, page_id % 5 AS rank FROM pg WHERE length(url) % 3 <> 0),
best AS (SELECT file_stem, min(rank) AS rank FROM f GROUP BY file_stem),
items AS (SELECT DISTINCT 'C' || conv_id AS file_stem FROM conversations)
SELECT items.file_stem, '/text/' || [{', '.join(f"'{p}'" for p in PLATFORMS)}][rank + 1] || '/' || items.file_stem || '.json' AS path
FROM items LEFT JOIN best USING (file_stem)""")
def priority_lookup(spark: SparkSession, d: str) -> DataFrame:
    files = _pages(spark, d).where(F.length("url") % 3 != 0)
    stem = F.concat(F.lit("C"), F.col("page_id") % 97)
    listed = files.select("platform", F.concat(F.lit("/text/"), "platform", F.lit("/"), stem, F.lit(".json")).alias("path"))
    items = fx.table(spark, d, "conversations").select(F.concat(F.lit("C"), "conv_id").alias("file_stem")).distinct()
    return manifest.priority_lookup(items, listed)


def _videos(spark: SparkSession, d: str, spelt: bool = False) -> DataFrame:
    """Numbered segments, single recordings and promotions of every page."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    count = (F.length("url") % 5).cast("int")
    stem = F.concat_ws("_", "code", host, "date")
    numbered = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(stem, F.lit("_视频"), k.cast("string"), F.lit(".mp4")),
    )
    promo = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(stem, F.lit("_宣传片.mp4")))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.col("page_id") % 4 == 0, F.array(F.concat(stem, F.lit(".mp4")))).otherwise(F.array().cast("array<string>"))
    names = _pages(spark, d, spelt).select("platform", F.explode(F.concat(numbered, promo, whole)).alias("name"))
    return names.select("platform", "name", F.concat(F.lit("/video/"), "platform", F.lit("/"), "name").alias("path"))


_PATH = "'/video/' || platform || '/' || name"


# Fixed values in it: the platforms and securities that have segments, and how many.
_PLAN_SQL = f"""WITH {_SQL_TASKS},
file AS (
  SELECT platform, code || '_' || regexp_extract(url, '://([^/]+)', 1) || '_' || date ||
    unnest(list_transform(range(1, length(url) % 5 + 1), lambda k: '_视频' || k || '.mp4')
      || CASE WHEN page_id % 3 = 0 THEN ['_宣传片.mp4'] ELSE [] END
      || CASE WHEN page_id % 4 = 0 THEN ['.mp4'] ELSE [] END) AS name FROM pg),
m AS (
  SELECT t.*, f.name, TRY_CAST(regexp_extract(f.name, '_视频(\\d+)', 1) AS INTEGER) AS seg,
    CASE WHEN t.platform IN ('上证', '中国证券网') THEN 2
      WHEN t.platform = '中证' AND video_number > 1 THEN
        CASE WHEN code = '301161' THEN 2 WHEN code IN ('001217', '301000', '301022', '301093', '301149', '301180', '301230') THEN 3 ELSE 0 END
    END AS top
  FROM task t LEFT JOIN file f ON f.platform = t.platform AND f.name LIKE t.code || '!_%!_' || t.date || '%.mp4' ESCAPE '!'),
c AS (
  SELECT *, CASE WHEN name IS NULL THEN FALSE
    WHEN top IS NULL THEN NOT contains(name, '宣传片')
    ELSE contains(name, '_' || date || '_视频') AND seg BETWEEN 1 AND top END AS used FROM m),
s AS (
  SELECT index2009, platform, code, date, video_number, top, CASE WHEN top IS NULL THEN 1 ELSE seg END AS slot,
    min({_PATH}) AS path, count(*) AS n FROM c WHERE used GROUP BY ALL),
g AS (
  SELECT index2009, string_agg(path, ',' ORDER BY CASE WHEN platform = '中证' THEN -slot ELSE slot END) AS paths,
    count(*) AS slots, sum(n) AS n FROM s GROUP BY index2009),
e AS (
  SELECT DISTINCT index2009, platform, code, date, video_number, top, CASE
    WHEN platform IN ('上证', '中国证券网') THEN least(2, video_number)
    WHEN top IS NULL THEN 1 WHEN code = '301161' OR top = 0 THEN 2 ELSE 3 END AS expected FROM m),
r AS (
  SELECT e.*, coalesce(paths, '') AS paths, coalesce(n, 0) AS candidates,
    coalesce(CASE WHEN top IS NULL THEN n ELSE slots END, 0) AS found FROM e LEFT JOIN g USING (index2009))
SELECT index2009, platform, code, date, video_number, paths, CAST(expected AS INTEGER) AS expected,
  CAST(found AS INTEGER) AS found, CAST(candidates AS BIGINT) AS candidates,
  CASE WHEN paths = '' THEN 'missing' WHEN found <> expected THEN 'mismatch' ELSE 'ok' END AS status FROM r"""


@query(_PLAN_SQL)
def segment_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = manifest.segment_plan(manifest.platform_pick(_index(spark, d)), _videos(spark, d))
    return plan.withColumn("paths", F.array_join("paths", ","))


_DAY_SQL = "strftime(DATE '2020-01-01' + CAST(page_id // 5 AS INTEGER), '{}')"
_SPELT_SQL = "CASE page_id % 3 " + " ".join(
    f"{when} {_DAY_SQL.format(spelling)}" for when, spelling in (("WHEN 0 THEN", "%Y_%m_%d"), ("WHEN 1 THEN", "%Y-%m-%d"), ("ELSE", "%Y%m%d"))
) + " END"


@query(_PLAN_SQL.replace(_DAY_SQL.format("%Y%m%d"), _SPELT_SQL).replace("|| t.date ||", "|| replace(t.date, '_', '!_') ||"))
def segment_plan_dated(spark: SparkSession, d: str) -> DataFrame:
    """Dates in three spellings, one with the sign that parts the names of files."""
    plan = manifest.segment_plan(manifest.platform_pick(_index(spark, d, spelt=True)), _videos(spark, d, spelt=True))
    return plan.withColumn("paths", F.array_join("paths", ","))


@query(f"""WITH {_SQL_PAGES}
SELECT platform, CAST(sum(length('{{"page_id":' || page_id || ',"url":"' || url || '"}}') + 1) AS BIGINT) AS bytes, TRUE AS has_files, TRUE AS paths_fit
FROM pg WHERE platform <> 'IR' GROUP BY platform""")
def media_listing(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "media")
    pages = _pages(spark, d).where(F.col("platform") != "IR").select("platform", "page_id", "url")
    pages.write.partitionBy("platform").option("maxRecordsPerFile", 1000).json(root)
    # the folder of the last platform does not exist and is passed over
    files = media.media_listing(spark, root, "transcript", folder="platform={platform}")
    return files.groupBy("platform").agg(
        F.sum("length").alias("bytes"),
        (F.count(F.lit(1)) > 0).alias("has_files"),
        F.bool_and(F.endswith("path", F.concat(F.lit("/platform="), "platform", F.lit("/"), "name"))).alias("paths_fit"),
    )
