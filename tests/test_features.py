from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from eventlens import schemas
from eventlens.functions import guarded as guard
from eventlens.operators import frames, manifest, scoring, verbal
from eventlens.plans.pitch import pitch_factor
from eventlens.session import scratch_path
from eventlens.sources import media, sinks, tables
from eventlens.sources.lexicon import read_lexicon
from eventlens.sources.transcripts import read_transcripts, transcript_rejects, transcript_segments
from eventlens.streaming import transcripts as stream
from eventlens.streaming.transcripts import append_new_results, process_new_batches, process_new_transcripts, read_results

SEGMENTS = "file_stem string, seg_no int, start double, end double, text string"


@pytest.fixture(scope="module")
def segments(spark):
    rows = [
        ("a", 0, 0.0, 2.0, " good day "), ("a", 1, 5.0, 4.0, "bad maybe good"), ("a", 2, None, 3.0, "  "),
        ("blank", 0, 0.0, 1.0, "　 "), ("none", None, None, None, None), ("digits", 0, 1.0, 1.0, "12 34"),
    ]
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.fixture(scope="module")
def lexicon(spark):
    words = [("positive", "good"), ("negative", "bad"), ("uncertainty", "maybe"), ("uncertainty", "bad"), ("positive", "g")]
    return spark.createDataFrame(words, "category string, word string")


def by_stem(df):
    return {r.file_stem: r for r in df.collect()}


def test_verbal_features(segments, lexicon):
    got = by_stem(verbal.verbal_features(segments, lexicon, "word"))
    a = got["a"]
    assert (a.total_words, a.total_chars, a.method, a.error) == (5, 19, "lexicon", "")
    assert (a.positive_ratio, a.negative_ratio, a.uncertain_ratio) == (0.4, 0.2, 0.4)
    assert a.tone_score == pytest.approx(0.2)
    for stem in ("blank", "none"):
        row = got[stem]
        assert (row.total_words, row.total_chars, row.method, row.tone_score) == (0, 0, "", None)
        assert row.error == "转录文本为空"
    digits = got["digits"]
    assert (digits.total_words, digits.total_chars, digits.tone_score, digits.error) == (0, 4, 0.0, "")


def test_char_tokens_and_shuffled_lexicon(segments, lexicon, monkeypatch):
    broadcast = by_stem(verbal.lexicon_tone(segments, lexicon))
    monkeypatch.setattr(verbal, "broadcast_within", lambda df: df)
    shuffled = by_stem(verbal.lexicon_tone(segments, lexicon))
    assert broadcast == shuffled
    assert broadcast["a"].total_words == 19 and broadcast["a"].positive_ratio == pytest.approx(2 / 19)
    assert broadcast["none"].tone_score == 0.0


def test_pandas_udf_plugins(spark, segments, lexicon):
    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.str.split(" ")

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or "maybe" in t else 0.75)

    assert by_stem(verbal.lexicon_tone(segments, lexicon, split))["a"].total_words == 5
    empty = spark.createDataFrame([], "category string, word string")
    got = by_stem(verbal.verbal_features(segments, empty, score=score(F.col("text"))))
    assert (got["a"].tone_score, got["a"].total_words, got["a"].method) == (0.5, 1, "snownlp")
    assert got["a"].uncertain_ratio is None and got["blank"].error == "转录文本为空"
    with pytest.raises(ValueError):
        verbal.verbal_features(segments, empty)


def test_polarity_without_scores(segments):
    row = by_stem(verbal.polarity_tone(segments, F.lit(None).cast("double")))["a"]
    assert (row.tone_score, row.positive_ratio, row.negative_ratio, row.total_words) == (0.0, 0.0, 0.0, 0)
    low = by_stem(verbal.polarity_tone(segments, F.lit(0.25)))["a"]
    assert (low.tone_score, low.positive_ratio, low.negative_ratio) == (-0.5, 0.0, 0.5)


def test_speech_rate(segments):
    got = {k: r.speech_rate for k, r in by_stem(verbal.speech_rate(segments)).items()}
    # seconds are 2, none for an end before its start, and 3 from a missing start
    assert got == {"a": pytest.approx(22 / 5), "blank": 0.0, "none": None, "digits": None}


def test_voiced_pitch(spark):
    df = spark.createDataFrame([("a", 50.0), ("a", 100.0), ("a", 200.0), ("b", 10.0)], "file_stem string, f0 double")
    got = {k: tuple(r)[1:] for k, r in by_stem(frames.voiced_pitch_stats(df)).items()}
    assert got == {"a": (150.0, 50.0), "b": (0.0, 0.0)}
    unvoiced = spark.createDataFrame([("a", float("nan")), ("c", float("nan"))], "file_stem string, f0 double")
    got = {k: tuple(r)[1:] for k, r in by_stem(frames.voiced_pitch_stats(df.union(unvoiced))).items()}
    assert got == {"a": (150.0, 50.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_samples_may_come_in_arrays_and_are_read_once(spark, tmp_path):
    x = [float(i % 7) for i in range(40)]
    single = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "file_stem string, sample_idx long, x double")
    chunks = spark.createDataFrame([("a", 0, x[:15]), ("a", 15, x[15:])], "file_stem string, sample_idx long, x array<double>")
    shape = dict(rate=10, hop=4, frame_length=8)
    one, other = (frames.frame_rms_stats(df, **shape).first() for df in (single, chunks))
    assert tuple(one)[1:] == pytest.approx(tuple(other)[1:])
    single.write.parquet(str(tmp_path / "x"))
    plan = frames.frame_rms_stats(spark.read.parquet(str(tmp_path / "x")), **shape)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "x") not in plan


def test_broken_transcripts_are_rejected_and_stems_decoded(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    good = json.dumps({"segments": [{"start": 0, "end": 1, "text": "hi"}]})
    (folder / "rec 1+2%.json").write_text(good)
    (folder / "part.json").write_text('{"segments": [{"start": 1\n{"segments": [{"start": "abc"}]}\n')
    got = read_transcripts(spark, str(folder)).collect()
    assert [(r.file_stem, len(r.segments)) for r in got] == [("rec 1+2%", 1)]
    lost = transcript_rejects(spark, str(folder)).collect()
    assert [r.file_stem for r in lost] == ["part", "part"] and all(r.error == "unreadable transcript" for r in lost)
    out, bad, progress = (str(tmp_path / n) for n in ("out", "bad", "progress"))
    for _ in range(2):
        process_new_transcripts(spark, str(folder), out, progress, rejected=bad)
    assert [r.file_stem for r in spark.read.parquet(out).collect()] == ["rec 1+2%"]
    assert spark.read.parquet(bad).count() == 2


def test_documents_of_one_recording_are_put_together(spark):
    rows = [("a", 0, [(0.0, 1.0, "x"), (1.0, 2.0, "y")]), ("a", 2, [(2.0, 3.0, "z")]), ("b", None, [])]
    got = transcript_segments(spark.createDataFrame(rows, schemas.TRANSCRIPT)).orderBy("file_stem", "seg_no").collect()
    assert [(r.file_stem, r.seg_no, r.text) for r in got] == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", None, None)]


def test_events_without_code_do_not_multiply_files(spark):
    """A thousand events without code and date look their files up once."""
    tasks = [(f"P{i}", "IR", "", "", 1) for i in range(1000)] + [("Q", "全景网", "600001", "20200101", 1)]
    tasks = spark.createDataFrame(tasks, "index2009 string, platform string, code string, date string, video_number int")
    names = [f"_{i}_x.mp4" for i in range(50)] + ["600001_t_20200101.mp4", "600001_t_20200102.mp4"]
    files = spark.createDataFrame([("IR" if n[0] == "_" else "全景网", f"/v/{n}", n) for n in names], "platform string, path string, name string")
    lookups = tasks.selectExpr("platform", "code", "date", "-1 AS top").distinct()
    listed = files.selectExpr("platform", "substring_index(name, '_', 1) AS code", "path", "name")
    assert manifest._candidates(lookups, listed).count() == 51
    plan = manifest.segment_plan(tasks, files).collect()
    assert len(plan) == 1001 and {tuple(r.paths) for r in plan if r.platform == "IR"} == {("/v/_0_x.mp4",)}
    assert [r.paths for r in plan if r.index2009 == "Q"] == [["/v/600001_t_20200101.mp4"]]


def test_sheets_under_their_own_headers(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("\ufeffINDEX2009, Stkcd ,日期,开始时间,结束时间,x\n01,1,2020-01-02,09:30,,\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_event_sheet(spark, str(sheet)).collect()] == [("01", "1", "2020-01-02", "09:30", None)]
    with pytest.raises(ValueError):
        tables.read_sheet(spark, str(sheet), {"absent": "a"})


@pytest.mark.parametrize("hop,length,center,n", [(4, 8, True, 30), (3, 8, True, 20), (4, 8, False, 30), (5, 5, True, 11), (8, 16, True, 7)])
def test_frame_rms(spark, hop, length, center, n):
    rng = random.Random(n)
    x = [rng.gauss(0, 1) for _ in range(n)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "file_stem string, sample_idx long, x double")
    got = frames.frame_rms_stats(df, rate=10, hop=hop, frame_length=length, center=center).first()
    pad = length // 2 if center else 0
    padded = [0.0] * pad + x + [0.0] * pad
    rms = [
        math.sqrt(sum(v * v for v in padded[s : s + length]) / length)
        for s in range(0, len(padded) - length + 1, hop)
    ]
    assert got.rms_mean == pytest.approx(np.mean(rms), abs=1e-12) and got.rms_std == pytest.approx(np.std(rms), abs=1e-12)
    assert got.duration_s == pytest.approx(n / 10)


def test_frames_of_a_step_without_common_divisor(spark):
    """Clips with gaps; quiet frames beside loud ones keep their digits; no more rows than two for a frame."""
    rng = random.Random(12)
    clips = {
        "dense": {i: rng.gauss(0, 1) for i in range(200)},
        "gaps": {i: rng.gauss(0, 1) for i in range(300) if i % 90 < 40},
        "quiet": {i: 1e4 if i < 32 else 1e-6 * rng.gauss(0, 1) for i in range(160)},
        "one": {0: 3.0},
    }
    rows = [(c, i, v) for c, x in clips.items() for i, v in x.items()]
    df = spark.createDataFrame(rows, "file_stem string, sample_idx long, x double")
    blocks = df.select("file_stem", F.col("sample_idx").alias("block"), (F.col("x") * F.col("x")).alias("energy"))
    got = {(r.file_stem, r.frame): r.energy for r in frames._frame_energies(blocks, 1, 7, 16, 8).collect()}
    want = {}
    for c, x in clips.items():
        for f in range(50):
            inside = [v * v for i, v in x.items() if 7 * f - 8 <= i < 7 * f + 8]
            if inside:
                want[c, f] = sum(inside)
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12), key
    stats = frames.frame_rms_stats(df, rate=10, hop=7, frame_length=16)
    assert {r.file_stem: r.duration_s for r in stats.collect()} == {c: len(x) / 10 for c, x in clips.items()}


def test_clip_shorter_than_a_frame(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "file_stem string, sample_idx long, x double")
    row = frames.frame_rms_stats(df, rate=2, hop=4, frame_length=8, center=False).first()
    assert (row.rms_mean, row.rms_std, row.duration_s) == (None, None, 1.0)


def test_sampling_and_labels(spark):
    def step(fps, sample=1.0):
        return spark.range(1).select(frames.sample_interval(F.lit(fps), sample)).first()[0]

    assert [step(2.5), step(3.5), step(0.0), step(-1.0), step(0.2), step(25.0, 2.0)] == [2, 4, 25, 25, 1, 12]
    rows = [("a", i, 2.0, e) for i, e in enumerate(["happy", "x", "Sadness", "x", None, "x", "calm", "x"])] + [("b", 0, 2.0, None)]
    df = spark.createDataFrame(rows, "file_stem string, frame_idx long, fps double, emotion string")
    got = by_stem(frames.label_ratios(frames.every_kth_sample(df)))
    a = got["a"]
    assert (a.frames_analyzed, a.frames_with_face) == (4, 3)
    assert a.positive_ratio + a.negative_ratio + a.neutral_ratio == pytest.approx(1) and a.net_positive == 0
    assert (got["b"].frames_analyzed, got["b"].positive_ratio, got["b"].net_positive) == (1, None, None)


@pytest.fixture(scope="module")
def modalities(spark):
    rng = np.random.default_rng(4)
    n = 60
    base = rng.normal(size=n + 5)
    vocal = [(f"s{i}", float(200 + 9 * base[i] + rng.normal()), float(rng.normal()), 1.0, None) for i in range(n)]
    verbal_rows = [(f"s{i}", float(base[i] + rng.normal()), None if i % 7 == 0 else float(rng.normal())) for i in range(5, n + 5)]
    visual = [(f"s{i}", float(rng.normal())) for i in range(0, n, 2)]
    return (
        spark.createDataFrame(vocal, "file_stem string, f0_mean double, f0_std double, rms_mean double, speech_rate double"),
        spark.createDataFrame(verbal_rows, "file_stem string, positive_ratio double, tone_score double"),
        spark.createDataFrame(visual, "file_stem string, net_positive double"),
    )


def test_pitch_factor_against_numpy(modalities):
    vocal, verbal_df, visual = modalities
    result = pitch_factor(vocal, verbal_df, visual, n_components=3)
    names = ["vocal_f0_mean", "vocal_f0_std", "vocal_rms_mean", "verbal_positive_ratio", "verbal_tone_score", "visual_net_positive"]
    assert result.fit.features == names
    merged = scoring.modality_join(vocal, verbal_df, visual).toPandas().sort_values("file_stem")
    x = merged[names].astype(float)
    x = x.fillna(x.mean())
    std = x.std(ddof=0).replace(0, 1)
    z = ((x - x.mean()) / std).to_numpy()
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1]
    for k in range(3):
        v = vectors[:, order[k]]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        np.testing.assert_allclose(result.fit.loadings[k], v, atol=1e-6)
        scores = result.scores.toPandas().sort_values("file_stem")[f"pc{k + 1}"]
        np.testing.assert_allclose(scores, z @ v, atol=1e-6)
    np.testing.assert_allclose(result.fit.ratios, values[order][:3] / values.sum(), atol=1e-9)
    gram = np.array(result.fit.loadings) @ np.array(result.fit.loadings).T
    np.testing.assert_allclose(gram, np.eye(3), atol=1e-9)
    table = scoring.loadings_table(result.scaled, result.fit).toPandas()
    assert list(table["pc1"]) == sorted(table["pc1"], reverse=True)
    summary = scoring.score_summary(result.scores).first()
    assert summary.n == len(merged) and summary.mean == pytest.approx(0, abs=1e-9)


def test_modality_joins(modalities):
    vocal, verbal_df, visual = modalities
    assert scoring.modality_join(vocal, verbal_df).count() == 55
    assert scoring.modality_join(vocal, verbal_df, min_vocal=False).count() == 65
    with pytest.raises(ValueError):
        pitch_factor(vocal.unionByName(vocal), verbal_df, visual)


def test_impute_and_zscore(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, None), ("b", None, 3.0, None), ("c", 3.0, 3.0, None)],
                               "file_stem string, x double, k double, e double")
    got = sorted(tuple(r) for r in scoring.mean_impute(df, ["x", "k", "e"]).collect())
    assert got == [("a", 1.0, 3.0, None), ("b", 2.0, 3.0, None), ("c", 3.0, 3.0, None)]
    scaled = sorted(tuple(r) for r in scoring.zscore(df, ["x", "k"]).collect())
    assert scaled == [("a", -1.0, 0.0, None), ("b", None, 0.0, None), ("c", 1.0, 0.0, None)]


def test_platform_pick(spark):
    rows = [("1", "上证 ", " 600001", "20200101", "x"), ("2", "IR", "600002", "20200102", "2"), ("3", None, "a", "b", "3"),
            ("4", "上证", "600004", None, "3")]
    df = spark.createDataFrame(rows, "index2009 string, platform string, `上证_去重代码` string, `上证_日期` string, `上证_视频数量` string")
    got = sorted(tuple(r) for r in manifest.platform_pick(df).collect())
    assert got == [("1", "上证", "600001", "20200101", 1), ("2", "IR", "", "", 1), ("4", "上证", "600004", "", 3)]


def test_segment_plan(spark):
    tasks = [("a", "上证", "600001", "d1", 2), ("b", "中证", "301000", "d1", 3), ("c", "中证", "301161", "d1", 2),
             ("d", "中证", "300999", "d1", 4), ("e", "中证", "300998", "d1", 1), ("f", "IR", "1", "d1", 1),
             ("g", "全景", "2", "d1", 1), ("h", "上证", "600001", "d9", 1)]
    files = [("上证", f"600001_x_d1_视频{k}.mp4") for k in ("2", "1", "3", "01", "1b")] + [
        ("中证", f"301000_x_d1_视频{k}.mp4") for k in (1, 2, 3)] + [("中证", f"301161_x_y_d1_视频{k}.mp4") for k in (1, 2, 3)] + [
        ("中证", "300999_x_d1_视频1.mp4"), ("中证", "300998_x_d1.mp4"), ("中证", "300998_x_d1_宣传片.mp4"),
        ("IR", "1_x_d1_b.mp4"), ("IR", "1_x_d1_a.mp4"), ("IR", "1_x_d2.mp4"), ("全景", "2_x_d1_宣传片.mp4"), ("全景", "2_x_d1.avi")]
    manifest_df = spark.createDataFrame(tasks, "index2009 string, platform string, code string, date string, video_number int")
    listed = spark.createDataFrame([(p, n, "/" + n) for p, n in files], "platform string, name string, path string")
    got = {r.index2009: r for r in manifest.segment_plan(manifest_df, listed).collect()}
    assert got["a"].paths == ["/600001_x_d1_视频1.mp4", "/600001_x_d1_视频2.mp4"]
    assert (got["a"].status, got["a"].found, got["a"].candidates) == ("ok", 2, 3)
    assert got["b"].paths == [f"/301000_x_d1_视频{k}.mp4" for k in (3, 2, 1)]
    assert got["c"].paths == [f"/301161_x_y_d1_视频{k}.mp4" for k in (2, 1)] and got["c"].expected == 2
    assert (got["d"].paths, got["d"].expected, got["d"].status) == ([], 2, "missing")
    assert (got["e"].paths, got["e"].status) == (["/300998_x_d1.mp4"], "ok")
    assert (got["f"].paths, got["f"].found, got["f"].status) == (["/1_x_d1_a.mp4"], 2, "mismatch")
    assert got["g"].status == got["h"].status == "missing" and got["h"].expected == 1


def test_segment_plan_finds_dates_of_any_spelling(spark):
    dates = ["2023_01_05", "2023-01-05", "20230105", "2023_1_5", "d_1"]
    tasks = [(d, "全景", "000001", d, 1) for d in dates] + [("two", "上证", "000001", "2023_01_05", 2), ("other", "全景", "000001", "2023_01_06", 1)]
    files = [("全景", f"000001_x_y_{d}.mp4") for d in dates] + [("上证", f"000001_x_2023_01_05_视频{k}.mp4") for k in (1, 2)]
    manifest_df = spark.createDataFrame(tasks, "index2009 string, platform string, code string, date string, video_number int")
    listed = spark.createDataFrame([(p, n, "/" + n) for p, n in files], "platform string, name string, path string")
    got = {r.index2009: r for r in manifest.segment_plan(manifest_df, listed).collect()}
    for d in dates:
        assert (got[d].paths, got[d].status) == ([f"/000001_x_y_{d}.mp4"], "ok"), d
    assert (len(got["two"].paths), got["two"].status, got["other"].status) == (2, "ok", "missing")


def test_lookups(spark):
    files = spark.createDataFrame([("IR", "/IR/s.json"), ("上证", "/上证/s.json"), ("other", "/o/t.json")], "platform string, path string")
    items = spark.createDataFrame([("s",), ("t",)], "file_stem string")
    assert sorted(tuple(r) for r in manifest.priority_lookup(items, files).collect()) == [("s", "/上证/s.json"), ("t", None)]
    tasks = spark.createDataFrame([("1", "c", "d"), ("2", "c", "d")], "index2009 string, code string, date string")
    audio = spark.createDataFrame([("1_c_d.wav", "/b"), ("1_c_d.wav", "/a")], "name string, path string")
    checked = manifest.manifest_check(tasks, audio)
    assert sorted(tuple(r) for r in checked.collect()) == [("1", "1_c_d.wav", "/a"), ("2", "2_c_d.wav", None)]
    assert tuple(manifest.manifest_counts(checked).first()) == (2, 1)


def test_media_listing(spark, tmp_path):
    for folder, name in (("上证路演音频", "a.wav"), ("IR路演音频", "b.wav"), ("IR路演音频", "c.txt"), ("other路演音频", "d.wav")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("xyz")
    got = {(r.platform, r.name, r.length) for r in media.media_listing(spark, str(tmp_path), "audio").collect()}
    assert got == {("上证", "a.wav", 3), ("IR", "b.wav", 3)}
    assert media.media_listing(spark, str(tmp_path), "video").count() == 0


def test_transcript_and_lexicon_files(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    segs = [{"start": 0.5, "end": 2, "text": "x", "extra": 1}, {"text": "y"}]
    (folder / "rec_1.json").write_text(json.dumps({"segments": segs}, indent=2))
    (folder / "rec_2.json").write_text("{}")
    rows = sorted(map(tuple, transcript_segments(read_transcripts(spark, str(folder), per_file=True)).collect()), key=str)
    assert rows == [("rec_1", 0, 0.5, 2.0, "x"), ("rec_1", 1, None, None, "y"), ("rec_2", None, None, None, None)]
    words = tmp_path / "lex"
    words.mkdir()
    (words / "positive.txt").write_text(" 好 \n\n# no\n好\nup\n")
    (words / "other.txt").write_text("zzz\n")
    assert sorted(map(tuple, read_lexicon(spark, str(words)).collect())) == [("positive", "up"), ("positive", "好")]
    assert read_lexicon(spark, str(tmp_path / "absent")).isEmpty()


def test_calendar_and_tables(spark, tmp_path):
    (tmp_path / "cal.json").write_text(json.dumps({"workdays": ["20240103", "20240102"]}, indent=1))
    assert [str(r.trade_date) for r in tables.read_calendar(spark, str(tmp_path / "cal.json")).orderBy("day_idx").collect()] == [
        "2024-01-02", "2024-01-03"]
    (tmp_path / "pairs.csv").write_text("x,ipo_id,rival_stkcd,ipo_stkcd\n1,7,000001,2\n")
    assert tuple(tables.read_pairs(spark, str(tmp_path / "pairs.csv"), "csv").first()) == ("7", "2", "000001")
    (tmp_path / "vocal.csv").write_text("file_stem,f0_mean,note\na,NaN,q\nb,2.5,q\n")
    got = tables.read_modality(spark, str(tmp_path / "vocal.csv"), "csv")
    assert sorted(map(tuple, got.collect())) == [("a", None, "q"), ("b", 2.5, "q")]
    assert scoring.modality_columns(got, "vocal_", scoring.VOCAL_FEATURES).columns == ["file_stem", "vocal_f0_mean"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_modality(spark, str(tmp_path / "absent"))


def test_incremental_runs_once_per_file(spark, lexicon, tmp_path):
    landing, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def arrive(stem):
        row = [(stem, None, [(0.0, 1.0, "good bad")])]
        spark.createDataFrame(row, schemas.TRANSCRIPT).write.mode("append").json(landing)

    arrive("a")
    process_new_transcripts(spark, landing, out, progress)
    arrive("b")
    for _ in range(2):
        process_new_transcripts(spark, landing, out, progress)
    assert sorted(r.file_stem for r in spark.read.parquet(out).collect()) == ["a", "b"]
    scored = scratch_path(spark, "scored")

    def handle(batch, _):
        sinks.sink_append(verbal.verbal_features(transcript_segments(batch), lexicon, "word"), scored)

    process_new_batches(spark, landing, str(tmp_path / "p2"), handle, max_files=1)
    assert {(r.file_stem, r.tone_score) for r in spark.read.parquet(scored).collect()} == {("a", 0.0), ("b", 0.0)}


def test_a_replayed_batch_is_added_once(spark, lexicon, tmp_path, monkeypatch):
    """The run ends after a batch is written and before it is marked as done."""
    landing, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for stem in "abc":
        row = [(stem, None, [(0.0, 1.0, "good bad good")])]
        spark.createDataFrame(row, schemas.TRANSCRIPT).coalesce(1).write.mode("append").json(landing)
    written = []

    def interrupted(df, path, by):
        sinks.replace_partitions(df, path, by)
        written.append(df.count())
        if len(written) == 2:
            raise RuntimeError("lost before the commit")

    features = lambda batch: verbal.verbal_features(transcript_segments(batch), lexicon, "word")
    monkeypatch.setattr(stream, "replace_partitions", interrupted)
    with pytest.raises(StreamingQueryException):
        append_new_results(spark, landing, out, progress, features, max_files=1)
    assert written == [1, 1]
    append_new_results(spark, landing, out, progress, features, max_files=1)
    append_new_results(spark, landing, out, progress, features, max_files=1)
    # the second batch was handed over again
    assert len(written) == 4
    assert sorted(r.file_stem for r in read_results(spark, out).collect()) == ["a", "b", "c"]


def test_failing_rows_of_a_scorer_are_told_apart(spark):
    def fragile(texts):
        if texts.str.contains("bad").any():
            raise KeyError("bad")
        return texts.str.len() / 10

    rows = [("a", "fine"), ("a", "bad one"), ("a", ""), ("b", None), ("b", "bad"), ("c", "good"), ("c", "well")] * 40
    df = spark.createDataFrame([(s, i, 0.0, 1.0, t) for i, (s, t) in enumerate(rows)], "file_stem string, seg_no int, start double, end double, text string")
    got = by_stem(verbal.guarded_polarity(df, fragile))
    assert (got["a"].total_words, got["a"].errors, got["a"].error) == (40, 40, "KeyError: 'bad'")
    assert got["a"].tone_score == pytest.approx((0.4 - 0.5) * 2)
    assert (got["b"].total_words, got["b"].errors, got["b"].tone_score) == (0, 40, 0.0)
    assert (got["c"].errors, got["c"].error) == (0, "")
    calls = []
    values = pd.Series([f"t{i}" for i in range(1024)])
    values[777] = "bad"
    out = guard.scored_or_failed(lambda t: (calls.append(len(t)), fragile(t))[1], values)
    assert len(calls) <= 21 and out["error"].notna().sum() == 1 and out["value"].isna().sum() == 1
    short = guard.scored_or_failed(lambda t: [1.0], pd.Series(["x", "y"]))
    assert short["value"].tolist() == [1.0, 1.0]
    assert guard.scored_or_failed(fragile, pd.Series([], dtype=str)).empty


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "parts")
    frame = lambda rows: spark.createDataFrame(rows, "v int, day string")
    sinks.replace_partitions(frame([(1, "a"), (2, "b")]), path, ["day"])
    sinks.replace_partitions(frame([(3, "b"), (4, "c")]), path, ["day"])
    sinks.replace_partitions(frame([]), path, ["day"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b"), (4, "c")]
    counts = sinks.sink_counted(frame([(1, "a"), (None, "b")]), str(tmp_path / "counted"), n=F.count(F.lit(1)), v=F.count("v"))
    assert counts == {"n": 2, "v": 1}


def test_feature_jobs_resume_and_score(spark, segments, lexicon, tmp_path):
    from eventlens.plans.features import run_pitch, run_verbal, run_visual, run_vocal

    rng, stems = random.Random(2), [f"s{i}" for i in range(8)]
    talk = spark.createDataFrame(
        [(s, 0, 0.0, 2.0 + i, "good " * i + "bad bad good") for i, s in enumerate(stems)], SEGMENTS)
    signal = spark.createDataFrame(
        [(s, i, rng.gauss(0, 1 + k)) for k, s in enumerate(stems) for i in range(40)], "file_stem string, sample_idx long, x double")
    pitch = spark.createDataFrame(
        [(s, i, rng.uniform(20, 300)) for s in stems[:-1] for i in range(9)], "file_stem string, frame_idx long, f0 double")
    shown = spark.createDataFrame(
        [(s, i, 1.0, rng.choice(["happy", "sad", None])) for s in stems for i in range(9)],
        "file_stem string, frame_idx long, fps double, emotion string")
    paths = {n: str(tmp_path / n) for n in ("vocal", "verbal", "visual", "pitch")}
    first = F.col("file_stem") < "s5"
    for rows in (first, F.lit(True), F.lit(True)):
        run_verbal(talk.where(rows), lexicon, paths["verbal"], "word")
        run_visual(shown.where(rows), paths["visual"])
        run_vocal(signal.where(rows), pitch, paths["vocal"], talk)
    for name in ("vocal", "verbal", "visual"):
        assert sorted(r.file_stem for r in spark.read.parquet(paths[name]).collect()) == stems
    assert [r.error for r in spark.read.parquet(paths["vocal"]).where("file_stem = 's7'").collect()] == ["no pitch frames"]
    _, summary = run_pitch(paths["vocal"], paths["verbal"], paths["visual"], paths["pitch"], n_components=2)
    assert summary.first().n == 8
    assert spark.read.parquet(paths["pitch"]).columns == ["file_stem", "pitch_factor", "pc1", "pc2"]
    # a visual table that does not exist is left out, a vocal one is missed
    result, _ = run_pitch(paths["vocal"], paths["verbal"], str(tmp_path / "absent"), paths["pitch"])
    assert not any(c.startswith("visual_") for c in result.scaled.columns)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_pitch(str(tmp_path / "absent"), paths["verbal"], None, paths["pitch"])


def test_span_is_pushed_down_and_zone_free(spark, sf):
    import datetime as dt

    from eventlens.catalog import fixtures as fx

    first, last = dt.date(2024, 1, 5), dt.date(2024, 1, 6)
    want = fx.ticks(spark, sf).where("to_date(ts) between '2024-01-05' and '2024-01-06'").count()
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "America/New_York", "Asia/Shanghai"):
            spark.conf.set("spark.sql.session.timeZone", other)
            scan = tables.scan_bars(fx.ticks(spark, sf), first, last)
            assert scan.count() == want
            assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in scan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
