"""Study inputs derived from the given tables, in Spark and in SQL.

Users stand for companies going public: the last purchase is the event. Ten
instruments take the users by remainder; an event is paired with the nine
instruments that its user does not belong to. All rows of the tables are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.text import word_tokens
from eventlens.operators.abnormal import abnormal_bars, event_series
from eventlens.operators.bars import align_market, bar_returns, resample_bars
from eventlens.operators.calendar import StudySpec, event_windows, trading_calendar
from eventlens.operators.cuts import CutSpec
from eventlens.operators.frames import every_kth_sample, frame_rms_stats, label_ratios, voiced_pitch_stats
from eventlens.operators.closes import closes_before, daily_closes
from eventlens.operators.pairs import instrument_span, pair_events, settled_spans, ticks_in_span
from eventlens.operators.verbal import lexicon_tone
from eventlens.session import Settled, settle, settled, spread

SPEC = StudySpec(estimation=((-12, -6), (-6, -3), (-3, -2)), event=(-1, 1))
# the tables hold round-the-clock hourly bars: a session of 9:00 to 15:00 whose
# first bar is the excluded one
CUT = CutSpec(day_open=9 * 60, day_close=15 * 60, excluded=9 * 60)
FREQ = "1 hour"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stock_code(k: Column) -> Column:
    """Six-digit code of instrument number 0 to 9, with leading zeros from 5 on."""
    return F.when(k < 5, (600000 + k).cast("string")).otherwise(F.lpad(k.cast("string"), 6, "0"))


SQL_CODE = "lpad(CAST(CASE WHEN {k} < 5 THEN 600000 + {k} ELSE {k} END AS VARCHAR), 6, '0')"
SQL_FULL = "(CASE WHEN {k} < 5 THEN 'SH' ELSE 'SZ' END || " + SQL_CODE + ")"


def ticks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 10
    venue = F.when(k < 5, "SH").otherwise("SZ")
    return table(spark, d, "events").select(
        F.concat(venue, stock_code(k)).alias("instrument"),
        "ts",
        F.col("event_id").alias("tick_id"),
        (F.col("value") + 100).alias("price"),
        F.lit(1.0).alias("size"),
    )


class Study:
    """Inputs of the event study over one data folder, each computed at most once."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    @cached_property
    def calendar(self) -> DataFrame:
        return settle(trading_calendar(table(self.spark, self.d, "events"), "ts"), "calendar")

    @cached_property
    def events(self) -> DataFrame:
        """``ipo_id, user_id, event_date, start_minute, end_minute`` from the last purchase."""
        last = (
            table(self.spark, self.d, "events")
            .where(F.col("event_type") == "purchase")
            .groupBy("user_id")
            .agg(F.max("ts").alias("last_ts"))
        )
        start = F.hour("last_ts") * 60 + F.minute("last_ts")
        dated = last.select(
            F.concat(F.lit("U"), F.col("user_id")).alias("ipo_id"),
            "user_id",
            F.to_date("last_ts").alias("event_date"),
            start.alias("start_minute"),
            F.when(start + 120 < 1440, start + 120).alias("end_minute"),
        )
        return settle(dated, "events")

    @cached_property
    def pairs(self) -> DataFrame:
        own = F.col("user_id") % 10
        return (
            spread(self.events).select("ipo_id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
            .where(F.col("k") != F.col("own"))
            .select("ipo_id", stock_code(F.col("own")).alias("ipo_stkcd"), stock_code(F.col("k")).alias("rival_stkcd"))
        )

    @cached_property
    def windows(self) -> DataFrame:
        return event_windows(self.events.select("ipo_id", "event_date"), self.calendar, SPEC)

    @cached_property
    def spelt_pairs(self) -> DataFrame:
        """The pairs, each twice, and once more without leading zeros."""
        code = F.col("rival_stkcd")
        spellings = F.explode(F.array(code, code, code.cast("int").cast("string"))).alias("rival_stkcd")
        return self.pairs.select("ipo_id", "ipo_stkcd", spellings)

    @cached_property
    def paired(self) -> DataFrame:
        return settle(pair_events(self.spelt_pairs, self.events, self.windows), "paired")

    @cached_property
    def bars(self) -> DataFrame:
        return bar_returns(settle(resample_bars(ticks(self.spark, self.d), FREQ), "bars"))

    @cached_property
    def market(self) -> DataFrame:
        """Bars over all ticks, as the market series."""
        everything = ticks(self.spark, self.d).withColumn("instrument", F.lit("MKT"))
        return bar_returns(settle(resample_bars(everything, FREQ), "market"))

    @cached_property
    def aligned(self) -> DataFrame:
        return align_market(self.bars, self.market)

    @cached_property
    def spans(self) -> Settled:
        return settled_spans(instrument_span(self.paired))

    @cached_property
    def study_aligned(self) -> DataFrame:
        """Bars of the instruments and days the events need, with the market's over the same days.

        The market is one more instrument, whose ticks are all ticks.
        """
        both = ticks(self.spark, self.d).withColumn("instrument", F.explode(F.array("instrument", F.lit("MKT"))))
        whole = self.spark.range(1).select(
            F.lit("MKT"), *[F.lit(self.spans.values[v]).cast("date") for v in ("first", "last")],
        )
        spans = self.spans.frame.select("rival_fc", "first_day", "last_day").union(whole)
        spans = Settled(spans, self.spans.rows + 1, self.spans.values)
        opens = closes_before(daily_closes(both), spans)
        market = F.col("instrument") == "MKT"
        bars = settled(bar_returns(resample_bars(ticks_in_span(both, spans), FREQ), opens=opens), "returns", market=F.count_if(market))
        return align_market(bars.frame.where(~market), Settled(bars.frame.where(market), bars.values["market"], {}))

    @cached_property
    def event_bars(self) -> DataFrame:
        return abnormal_bars(self.study_aligned, self.calendar, self.paired, SPEC)

    @cached_property
    def series(self) -> Settled:
        """The abnormal series of instruments and event days, stored."""
        lazy = event_series(self.study_aligned, self.calendar, self.paired, SPEC)
        return Settled(settle(lazy.frame, "series"), lazy.rows, lazy.values)


def raw_index(spark: SparkSession, d: str, purchases: bool = True) -> DataFrame:
    """An event sheet as text, one row per purchase or per event, with malformed entries."""
    n = F.col("event_id")
    later = F.col("ts") + F.expr("INTERVAL 2 HOURS")
    hour_only = F.concat(F.hour("ts").cast("string"), F.date_format("ts", ":mm"))
    start = (
        F.when(n % 5 == 0, F.date_format("ts", "HH:mm:ss"))
        .when(n % 5 == 1, F.date_format("ts", "HH:mm"))
        .when(n % 5 == 2, hour_only)
        .when(n % 5 == 3, F.date_format("ts", "HH：mm"))
    )
    return (
        table(spark, d, "events")
        .where((F.col("event_type") == "purchase") if purchases else F.lit(True))
        .select(
            F.concat(F.lit("U"), F.col("user_id")).alias("ipo_id"),
            stock_code(F.col("user_id") % 10).alias("ipo_stkcd"),
            F.when(n % 13 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("roadshow_date"),
            start.alias("start_time"),
            F.when(n % 11 == 0, "25:00").otherwise(F.date_format(later, "HH:mm")).alias("end_time"),
        )
    )


SQL_RAW_INDEX = f"""raw_index AS (
  SELECT 'U' || user_id AS ipo_id, {SQL_CODE.format(k='(user_id % 10)')} AS ipo_stkcd,
    CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS roadshow_date,
    CASE event_id % 5 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M')
      WHEN 2 THEN hour(ts) || strftime(ts, ':%M') WHEN 3 THEN strftime(ts, '%H') || '：' || strftime(ts, '%M')
    END AS start_time,
    CASE WHEN event_id % 11 = 0 THEN '25:00' ELSE strftime(ts + INTERVAL 2 HOUR, '%H:%M') END AS end_time
  FROM events WHERE event_type = 'purchase')"""

SQL_RAW_EVENTS = SQL_RAW_INDEX.replace(" WHERE event_type = 'purchase'", "")

_K = "(user_id % 10)"


def sql_bars(name: str, instrument: str, bucket: str = "1 hour", where: str = "") -> str:
    """Bars and returns of all ticks, by window functions over raw ticks."""
    return f"""{name}_raw AS (
  SELECT {instrument} AS instrument, time_bucket(INTERVAL '{bucket}', ts) AS ts,
    last(100 + value ORDER BY ts, event_id) AS price, CAST(count(*) AS DOUBLE) AS volume
  FROM events {where} GROUP BY 1, 2),
{name} AS (
  SELECT *, CAST(ts AS DATE) AS trade_date,
    lag(price) OVER (PARTITION BY instrument ORDER BY ts) AS prev_price,
    price / lag(price) OVER (PARTITION BY instrument ORDER BY ts) - 1 AS ret
  FROM {name}_raw)"""


SQL_BARS = sql_bars("bars", SQL_FULL.format(k=_K))
SQL_MARKET = sql_bars("mkt", "'MKT'")
SQL_CALENDAR = """cal AS (
  SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS INTEGER) AS day_idx
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events))"""
SQL_EVENTS = """ev0 AS (
  SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'purchase' GROUP BY user_id),
ev AS (
  SELECT 'U' || user_id AS ipo_id, user_id, CAST(last_ts AS DATE) AS event_date,
    CAST(hour(last_ts) * 60 + minute(last_ts) AS INTEGER) AS start_minute,
    CAST(CASE WHEN hour(last_ts) * 60 + minute(last_ts) + 120 < 1440
      THEN hour(last_ts) * 60 + minute(last_ts) + 120 END AS INTEGER) AS end_minute
  FROM ev0)"""


def sql_windows(spec: StudySpec) -> str:
    offsets = spec.offsets()
    return f"""win AS (
  SELECT ipo_id, event_date, c.day_idx,
    {', '.join(f'w{i}.trade_date AS {name}' for i, name in enumerate(offsets))}
  FROM ev JOIN cal c ON c.trade_date = ev.event_date
    {' '.join(f'JOIN cal w{i} ON w{i}.day_idx = c.day_idx + ({n})' for i, n in enumerate(offsets.values()))})"""


SQL_WINDOWS = sql_windows(SPEC)
SQL_PAIRS = f"""prs AS (
  SELECT ipo_id, {SQL_CODE.format(k=_K)} AS ipo_stkcd, {SQL_CODE.format(k='k')} AS rival_stkcd,
    {SQL_FULL.format(k='k')} AS rival_fc
  FROM ev, range(10) t(k) WHERE k <> user_id % 10)"""
SQL_PAIRED = """pw AS (SELECT p.*, w.* EXCLUDE (ipo_id) FROM prs p JOIN win w USING (ipo_id))"""
SQL_ALIGNED = """al AS (
  SELECT b.*, m.ret AS market_return, c.day_idx
  FROM bars b LEFT JOIN mkt m ON m.ts = b.ts JOIN cal c ON c.trade_date = b.trade_date)"""


def _estimate(k: int) -> str:
    inside = f"FILTER (WHERE a.trade_date BETWEEN r.est{k}_start AND r.est{k}_end)"
    return f"""CAST(regr_count(a.ret, a.market_return) {inside} AS BIGINT) AS n_est{k},
    regr_intercept(a.ret, a.market_return) {inside} AS alpha_est{k},
    regr_slope(a.ret, a.market_return) {inside} AS beta_est{k},
    count(a.volume) {inside} AS vol_n_est{k},
    avg(a.volume) {inside} AS vol_mean_est{k}"""


def sql_estimates(spec: StudySpec) -> str:
    """Least squares and means over raw bars of each window."""
    return f"""req AS (
  SELECT DISTINCT rival_fc AS instrument, event_date, {', '.join(spec.offsets())} FROM pw),
coef AS (
  SELECT r.instrument, r.event_date,
    {', '.join(_estimate(k) for k in spec.numbers)}
  FROM req r LEFT JOIN al a ON a.instrument = r.instrument
    AND a.trade_date BETWEEN r.est1_start AND r.est3_end
  GROUP BY r.instrument, r.event_date)"""


def sql_event_bars(spec: StudySpec, volume: str) -> str:
    returns = ", ".join(f"a.ret - (c.alpha_est{k} + c.beta_est{k} * a.market_return) AS ar_est{k}" for k in spec.numbers)
    volumes = ", ".join(volume.format(v="a.volume", base=f"c.vol_mean_est{k}") + f" AS av_est{k}" for k in spec.numbers)
    return f"""eb AS (
  SELECT p.ipo_id, p.rival_fc, p.event_date, a.ts AS "timestamp", {returns}, {volumes}
  FROM pw p JOIN al a ON a.instrument = p.rival_fc
    AND a.trade_date BETWEEN p.event_start AND p.event_end
  JOIN coef c ON c.instrument = p.rival_fc AND c.event_date = p.event_date)"""


SQL_ESTIMATES = sql_estimates(SPEC)
SQL_EVENT_BARS = sql_event_bars(SPEC, "{v} - {base}")

SQL_STUDY = ",\n".join([SQL_CALENDAR, SQL_EVENTS, SQL_WINDOWS, SQL_PAIRS, SQL_PAIRED])
SQL_ESTIMATION = ",\n".join([SQL_STUDY, SQL_BARS, SQL_MARKET, SQL_ALIGNED, SQL_ESTIMATES])
SQL_ABNORMAL = ",\n".join([SQL_ESTIMATION, SQL_EVENT_BARS])


# --- daily study with the default windows -------------------------------------
# Ten instruments by supplier number; an event per instrument and quarter on the
# first of its dates with all offsets inside the calendar.

DAILY_SPEC = StudySpec()
_REACH = max(-first for first, _ in DAILY_SPEC.estimation)


class DailyStudy:
    """Daily bars of shipped quantities and their mean price."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d

    def _bars(self, instrument: Column, name: str) -> DataFrame:
        day = F.to_date("l_shipdate").cast("timestamp_ntz")
        daily = (
            table(self.spark, self.d, "lineitem")
            .groupBy(instrument.alias("instrument"), day.alias("ts"))
            .agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("volume"))
        )
        priced = daily.select("instrument", "ts", F.try_divide("value", "volume").alias("price"), "volume")
        return settle(priced, name)

    @cached_property
    def stored(self) -> DataFrame:
        k = F.col("l_suppkey") % 10
        return self._bars(F.concat(F.when(k < 5, "SH").otherwise("SZ"), stock_code(k)), "daily")

    @cached_property
    def aligned(self) -> DataFrame:
        market = bar_returns(self._bars(F.lit("MKT"), "daily_market"), "year")
        return settle(align_market(bar_returns(self.stored, "year"), market), "daily_aligned")

    @cached_property
    def calendar(self) -> DataFrame:
        return settle(trading_calendar(self.stored, "ts"), "calendar")

    @cached_property
    def events(self) -> DataFrame:
        days = self.stored.select("instrument", F.to_date("ts").alias("trade_date"))
        last = self.calendar.count()
        usable = F.broadcast(self.calendar.where((F.col("day_idx") > _REACH) & (F.col("day_idx") < last)))
        quarter = F.concat(F.year("trade_date"), F.lit("Q"), F.quarter("trade_date"))
        return (
            days.join(usable, "trade_date")
            .groupBy("instrument", quarter.alias("quarter"))
            .agg(F.min("trade_date").alias("event_date"))
            .select(F.concat_ws("-", "instrument", "quarter").alias("ipo_id"), "instrument", "event_date")
        )

    @cached_property
    def pairs(self) -> DataFrame:
        own = F.substring("instrument", 3, 6)
        rivals = F.array(*[stock_code(F.lit(k)) for k in range(10)])
        return (
            self.events.select("ipo_id", own.alias("ipo_stkcd"), F.explode(rivals).alias("rival_stkcd"))
            .where(F.col("rival_stkcd") != F.col("ipo_stkcd"))
        )

    @cached_property
    def paired(self) -> DataFrame:
        events = settle(self.events, "events")
        windows = event_windows(events.select("ipo_id", "event_date"), self.calendar, DAILY_SPEC)
        return pair_events(self.pairs, events, windows)

    def event_bars(self, volume_method: str) -> DataFrame:
        return abnormal_bars(self.aligned, self.calendar, self.paired, DAILY_SPEC, volume_method)


_SUPPLIER = SQL_FULL.format(k="(l_suppkey % 10)")


def _sql_daily(name: str, instrument: str) -> str:
    return f"""{name}_raw AS (
  SELECT {instrument} AS instrument, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
    sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
{name} AS (
  SELECT *, CAST(ts AS DATE) AS trade_date,
    price / lag(price) OVER (PARTITION BY instrument ORDER BY ts) - 1 AS ret FROM {name}_raw)"""


SQL_DAILY = ",\n".join([
    _sql_daily("bars", _SUPPLIER),
    _sql_daily("mkt", "'MKT'"),
    """cal AS (
  SELECT trade_date, CAST(row_number() OVER (ORDER BY trade_date) AS INTEGER) AS day_idx
  FROM (SELECT DISTINCT trade_date FROM bars))""",
    f"""ev AS (
  SELECT instrument || '-' || year(trade_date) || 'Q' || quarter(trade_date) AS ipo_id, instrument, min(trade_date) AS event_date
  FROM bars JOIN cal USING (trade_date) WHERE day_idx > {_REACH} AND day_idx < (SELECT max(day_idx) FROM cal)
  GROUP BY instrument, year(trade_date), quarter(trade_date))""",
    sql_windows(DAILY_SPEC),
    f"""prs AS (
  SELECT ipo_id, {SQL_FULL.format(k='k')} AS rival_fc FROM ev, range(10) t(k) WHERE {SQL_FULL.format(k='k')} <> instrument)""",
    SQL_PAIRED,
    SQL_ALIGNED,
    sql_estimates(DAILY_SPEC),
    sql_event_bars(DAILY_SPEC, "{v} / {base} - 1"),
])


# --- recordings --------------------------------------------------------------
# Conversations stand for transcripts, documents for transcripts of one segment,
# embeddings for signals and users' events for labelled video frames.

# Segments in one stored document; a longer recording is several documents.
SEGMENTS_PER_DOCUMENT = 200
FRAME_FPS = 2.5
SIGNAL = {"rate": 16, "hop": 8, "frame_length": 16}


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segment rows from conversation turns, a conversation being a recording."""
    turn = F.col("turn")
    start = (turn * 10).cast("double")
    return table(spark, d, "conversations").select(
        F.concat(F.lit("C"), F.col("conv_id")).alias("file_stem"),
        turn.cast("int").alias("seg_no"),
        start.alias("start"),
        (start + 1 + F.length("text") % 9).alias("end"),
        "text",
    )


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcript documents; a recording of many segments is several that say where they begin."""
    part = F.floor(F.col("seg_no") / SEGMENTS_PER_DOCUMENT)
    rows = F.sort_array(F.collect_list(F.struct("seg_no", "start", "end", "text")))
    return (
        segments(spark, d)
        .groupBy("file_stem", part.alias("part"))
        .agg(rows.alias("rows"), F.min("seg_no").alias("first_segment"))
        .select(
            "file_stem",
            "first_segment",
            F.transform(
                "rows",
                lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")),
            ).alias("segments"),
        )
    )


def document_segments(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(
        F.col("doc_id").cast("string").alias("file_stem"),
        F.lit(0).alias("seg_no"),
        F.lit(0.0).alias("start"),
        (F.col("n_chars") / 15.0).alias("end"),
        "text",
    )


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Frequent words of the documents, put into categories by their length.

    Words of seven letters are in two categories.
    """
    documents = table(spark, d, "documents")
    frequent = (
        spread(documents).select(F.explode(word_tokens(F.col("text"))).alias("word"))
        .groupBy("word")
        .count()
        .where(F.col("count") >= F.lit(documents.count() / 5))
    )
    size = F.length("word")
    category = (
        F.when(size % 3 == 0, F.array(F.lit("positive")))
        .when(size == 7, F.array(F.lit("negative"), F.lit("positive")))
        .when(size % 3 == 1, F.array(F.lit("negative")))
        .otherwise(F.array(F.lit("uncertainty")))
    )
    return frequent.select(F.explode(category).alias("category"), "word")


def frame_labels(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a video per user; frames without a face have no label."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("file_stem"),
        F.col("event_id").alias("frame_idx"),
        F.when(F.col("user_id") % 7 == 0, 0.0).otherwise(FRAME_FPS).alias("fps"),
        F.when(kind == "purchase", "Happiness")
        .when(kind == "signup", "surprise")
        .when(kind == "error", "ANGER")
        .when(kind == "view", "neutral")
        .alias("emotion"),
    )


def signal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("file_stem"),
        F.posexplode("embedding").alias("sample_idx", "x"),
    ).withColumn("x", F.col("x").cast("double"))


def pitch_frames(spark: SparkSession, d: str) -> DataFrame:
    return signal(spark, d).select("file_stem", F.col("sample_idx").alias("frame_idx"), (F.col("x") * 1000 + 200).alias("f0"))


def vocal(spark: SparkSession, d: str) -> DataFrame:
    """Vocal features; without transcripts the speech rate is all NULL."""
    pitch = voiced_pitch_stats(pitch_frames(spark, d))
    energy = frame_rms_stats(signal(spark, d), **SIGNAL)
    return pitch.join(energy, "file_stem").withColumn("speech_rate", F.lit(None).cast("double"))


def verbal(spark: SparkSession, d: str) -> DataFrame:
    return lexicon_tone(document_segments(spark, d), lexicon(spark, d), "word")


def visual(spark: SparkSession, d: str) -> DataFrame:
    return label_ratios(every_kth_sample(frame_labels(spark, d)))


SQL_SEGMENTS = """seg AS (
  SELECT 'C' || conv_id AS file_stem, CAST(turn AS INTEGER) AS seg_no, CAST(turn * 10 AS DOUBLE) AS "start",
    CAST(turn * 10 + 1 + length(text) % 9 AS DOUBLE) AS "end", text
  FROM conversations)"""
SQL_CLEAN = r"regexp_replace({t}, '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z]', ' ', 'g')"
SQL_WORDS = f"""tok AS (
  SELECT doc_id, w AS word FROM (
    SELECT doc_id, unnest(string_split({SQL_CLEAN.format(t='text')}, ' ')) AS w FROM documents)
  WHERE w <> '')"""
SQL_LEXICON = """freq AS (
  SELECT word, length(word) AS n FROM tok GROUP BY word
  HAVING count(*) >= (SELECT count(*) / 5 FROM documents)),
lex AS (
  SELECT 'positive' AS category, word FROM freq WHERE n % 3 = 0 OR n = 7
  UNION ALL SELECT 'negative', word FROM freq WHERE n % 3 = 1
  UNION ALL SELECT 'uncertainty', word FROM freq WHERE n % 3 = 2)"""
SQL_FRAMES = f"""fr0 AS (
  SELECT CAST(user_id AS VARCHAR) AS file_stem, event_id AS frame_idx,
    CAST(CASE WHEN user_id % 7 = 0 THEN 25 ELSE {FRAME_FPS} END AS DOUBLE) AS fps,
    CASE event_type WHEN 'purchase' THEN 'happy' WHEN 'signup' THEN 'surprise'
      WHEN 'error' THEN 'angry' WHEN 'view' THEN 'neutral' END AS emotion
  FROM events),
fr AS (SELECT *, CAST(greatest(1, round_even(fps, 0)) AS BIGINT) AS step FROM fr0),
kept AS (SELECT * FROM fr WHERE frame_idx % step = 0)"""
SQL_VISUAL = """vis AS (
  SELECT file_stem,
    count(*) FILTER (WHERE emotion IN ('happy', 'surprise')) / nullif(count(emotion), 0) AS positive_ratio,
    count(*) FILTER (WHERE emotion = 'angry') / nullif(count(emotion), 0) AS negative_ratio,
    count(*) FILTER (WHERE emotion = 'neutral') / nullif(count(emotion), 0) AS neutral_ratio,
    (count(*) FILTER (WHERE emotion IN ('happy', 'surprise')) - count(*) FILTER (WHERE emotion = 'angry'))
      / nullif(count(emotion), 0) AS net_positive,
    count(*) AS frames_analyzed, count(emotion) AS frames_with_face
  FROM kept GROUP BY file_stem)"""
_PAD = SIGNAL["frame_length"] // 2
SQL_SIGNAL = f"""sig AS (
  SELECT CAST(vec_id AS VARCHAR) AS file_stem, CAST(unnest(embedding) AS DOUBLE) AS x,
    generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pit AS (
  SELECT file_stem, coalesce(avg(x * 1000 + 200) FILTER (WHERE x * 1000 + 200 > 50), 0.0) AS f0_mean,
    coalesce(stddev_pop(x * 1000 + 200) FILTER (WHERE x * 1000 + 200 > 50), 0.0) AS f0_std
  FROM sig GROUP BY file_stem),
len AS (SELECT file_stem, count(*) AS n FROM sig GROUP BY file_stem),
frm AS (SELECT file_stem, n, unnest(range(n // {SIGNAL['hop']} + 1)) AS f FROM len),
en AS (
  SELECT frm.file_stem, f, any_value(n) AS n, sqrt(coalesce(sum(x * x), 0) / {SIGNAL['frame_length']}) AS rms
  FROM frm LEFT JOIN sig ON sig.file_stem = frm.file_stem
    AND i >= f * {SIGNAL['hop']} - {_PAD} AND i < f * {SIGNAL['hop']} + {_PAD}
  GROUP BY frm.file_stem, f),
rms AS (
  SELECT file_stem, avg(rms) AS rms_mean, stddev_pop(rms) AS rms_std, any_value(n) / {SIGNAL['rate']} AS duration_s
  FROM en GROUP BY file_stem)"""
SQL_TONE = """hit AS (
  SELECT doc_id, word, word IN (SELECT word FROM lex WHERE category = 'positive') AS pos,
    word IN (SELECT word FROM lex WHERE category = 'negative') AS neg,
    word IN (SELECT word FROM lex WHERE category = 'uncertainty') AS unc FROM tok),
cnt AS (SELECT doc_id, count(*) AS n, count_if(pos) AS p, count_if(neg) AS m, count_if(unc) AS u FROM hit GROUP BY doc_id),
ton AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_stem, coalesce(p / n, 0) AS positive_ratio, coalesce(m / n, 0) AS negative_ratio,
    coalesce(u / n, 0) AS uncertain_ratio, coalesce((p - m) / n, 0) AS tone_score, coalesce(n, 0) AS total_words
  FROM documents LEFT JOIN cnt USING (doc_id))"""
SQL_MATRIX = f"""{SQL_WORDS}, {SQL_LEXICON}, {SQL_TONE}, {SQL_SIGNAL}, {SQL_FRAMES}, {SQL_VISUAL},
mat AS (
  SELECT p.file_stem, p.f0_mean AS vocal_f0_mean, p.f0_std AS vocal_f0_std, r.rms_mean AS vocal_rms_mean,
    r.rms_std AS vocal_rms_std, CAST(NULL AS DOUBLE) AS vocal_speech_rate,
    t.positive_ratio AS verbal_positive_ratio, t.negative_ratio AS verbal_negative_ratio,
    t.uncertain_ratio AS verbal_uncertain_ratio, t.tone_score AS verbal_tone_score,
    v.positive_ratio AS visual_positive_ratio, v.negative_ratio AS visual_negative_ratio,
    v.net_positive AS visual_net_positive
  FROM pit p JOIN rms r USING (file_stem) JOIN ton t USING (file_stem) LEFT JOIN vis v USING (file_stem))"""
MATRIX_COLUMNS = [
    "vocal_f0_mean", "vocal_f0_std", "vocal_rms_mean", "vocal_rms_std", "vocal_speech_rate",
    "verbal_positive_ratio", "verbal_negative_ratio", "verbal_uncertain_ratio", "verbal_tone_score",
    "visual_positive_ratio", "visual_negative_ratio", "visual_net_positive",
]
