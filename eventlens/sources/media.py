"""Listing of media files in the platforms' folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.operators.manifest import PLATFORMS

# Folder suffix and file pattern per kind of media.
KINDS = {
    "video": ("路演视频", "*.mp4"),
    "audio": ("路演音频", "*.wav"),
    "transcript": ("路演转录", "*.json"),
}


def media_listing(
    spark: SparkSession,
    root: str,
    kind: str,
    platforms: list[str] = PLATFORMS,
    folder: str = "{platform}{suffix}",
) -> DataFrame:
    """``platform, path, name, length`` of a kind of file; absent folders are skipped.

    Only file metadata is read, never content.
    """
    suffix, pattern = KINDS[kind]
    folders = [folder.format(platform=p, suffix=suffix) for p in platforms]
    try:
        # one brace pattern: alternatives that do not exist match nothing
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(f"{root.rstrip('/')}/{{{','.join(folders)}}}")
            .select("path", "length")
        )
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "platform string, path string, name string, length long")
    parts = F.split("path", "/")
    parent = F.element_at(parts, -2)
    platform = F.coalesce(*[F.when(parent == name, p) for p, name in zip(platforms, folders)])
    return files.select(platform.alias("platform"), "path", F.element_at(parts, -1).alias("name"), "length")
