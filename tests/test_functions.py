from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions import codes, labels, nulls, text, times


def column(spark, values, make, kind="string"):
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("v", T._parse_datatype_string(kind))])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_full_code(spark):
    given = ["1", "300750", "600000", "830001", "900901", "200011", "430001", "1234567", " 89 ", "x", None]
    assert column(spark, given, codes.full_code) == [
        "SZ000001", "SZ300750", "SH600000", "BJ830001", "SH900901", "BJ200011",
        "未知交易所430001", "未知交易所1234567", "SZ000089", None, None,
    ]


def test_parse_hhmm(spark):
    given = ["09:30", "9:30", "25:00", "09：30", "", None, "9:30:00", "23:59:59", "12-61"]
    assert column(spark, given, times.parse_hhmm) == [570, None, None, 570, None, None, None, 1439, None]


def test_parse_date(spark):
    given = ["2021-03-05", "2021/3/5", "20210305", "2021-03-05 10:00:00", "n/a", "", None]
    day = dt.date(2021, 3, 5)
    assert column(spark, given, times.parse_date) == [day, day, day, day, None, None, None]


def test_minutes(spark):
    given = [dt.datetime(2024, 1, 2, 9, 25), dt.datetime(2024, 1, 2, 9, 25, 1), None]
    assert column(spark, given, lambda c: times.is_minute(c, 565), "timestamp_ntz") == [True, False, None]
    assert column(spark, [dt.date(2024, 1, 2)], lambda c: times.at_minute(c, 570), "date") == [
        dt.datetime(2024, 1, 2, 9, 30)
    ]


def test_text(spark):
    given = ["  你好,world 3!", "　\t", "", None]
    assert column(spark, given, text.strip) == ["你好,world 3!", "", "", None]
    assert column(spark, given, text.clean_text) == ["  你好 world   ", "  ", "", None]
    assert column(spark, given, lambda c: text.tokens(c, "char")) == [list("你好world"), [], [], None]
    assert column(spark, given, lambda c: text.tokens(c, "word")) == [["你好", "world"], [], [], None]
    assert column(spark, given[:1], lambda c: text.tokens(c, lambda t: F.split(t, " "))) == [["你好", "world"]]
    assert column(spark, ["/a/b.c/d_e.x.json", "d", ".hidden"], text.path_stem) == ["d_e.x", "d", ".hidden"]


def test_labels(spark):
    given = ["Anger", "sadness", "HAPPY", "surprise", "neutral", "other", None]
    assert column(spark, given, labels.label_class) == [
        "negative", "negative", "positive", "positive", "neutral", "neutral", None,
    ]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "x double, s string")
    assert [r.x for r in nulls.nan_to_null(df).orderBy("s").collect()] == [1.0, None, None]


def test_char_counts_without_a_row_per_letter(spark):
    from collections import Counter

    texts = ["aAbb 中文中 z9-é", "", "!!", None, "ab" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.inline(text.char_counts(F.col("t")))).collect()
    assert len([r for r in rows if r["i"] == 4]) == 2
    found = Counter()
    for r in rows:
        found[r["i"], r["word"]] += r["n"]
    plain = df.select("i", F.explode(text.char_tokens(F.col("t"))).alias("word")).collect()
    assert found == Counter((r["i"], r["word"]) for r in plain)


def test_python_gets_few_texts_at_a_time(spark):
    conf = spark.conf
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: conf.get(k) for k in keys}
    try:
        sizes = F.pandas_udf(lambda t: t.map(lambda _: [f"n{'x' * len(t)}"]), "array<string>")
        docs = spark.range(0, 3000, 1, 1).select(F.lit("some text").alias("t"))
        most = docs.select(F.max(F.length(text.tokens(F.col("t"), sizes)[0]) - 1)).first()[0]
        assert most <= 256
    finally:
        for k, v in before.items():
            conf.set(k, v)
