"""Word lists in text files, one word per line, one file per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventlens.functions.text import path_stem, strip
from eventlens.operators.verbal import CATEGORIES

EMPTY = "category string, word string"


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """Distinct ``category, word`` from ``category, value`` lines.

    Blank lines and lines starting with ``#`` are comments.
    """
    word = strip(F.col("value"))
    return (
        lines.select("category", word.alias("word"))
        .where((F.col("word") != "") & ~F.startswith("word", F.lit("#")))
        .distinct()
    )


def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the known categories in a folder; an absent file is an empty list.

    A category is a file ``{category}.txt`` or a folder ``category={category}``.
    """
    names = ",".join(f"{c}.txt,category={c}" for c in CATEGORIES)
    try:
        raw = spark.read.text(f"{folder}/{{{names}}}").select("value", "_metadata.file_path")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], EMPTY)
    in_folder = F.regexp_extract("file_path", "/category=([^/]+)/", 1)
    category = F.when(in_folder != "", in_folder).otherwise(path_stem(F.col("file_path")))
    return parse_lexicon(raw.select(category.alias("category"), "value"))
