"""Operators against small brute force, and the traps of their definitions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import arrays as A
from sensorloom.functions import cleaning as C
from sensorloom.functions import dsp
from sensorloom.functions.text import formatted, rounded_list
from sensorloom.operators import align, answers, metrics, sampling, segments
from sensorloom.plans import agents, experiment, prompts, render
from sensorloom.plans.scorer import MockScorer, scored
from sensorloom.sources import recordings, store


def one(spark, value, kind, *exprs):
    return spark.createDataFrame([(value,)], f"x {kind}").select(*(e.alias(f"c{i}") for i, e in enumerate(exprs))).first()


def test_gap_is_strict_and_null_times_go(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 5.0, 10.0001, None, 11.0)], "s string, t double")
    got = segments.gap_segments(df, ["s"], "t", 5.0).orderBy("t").collect()
    assert [r.segment_id for r in got] == [0, 0, 1, 1]


def test_label_islands_break_on_null(spark):
    labels = [0, 0, None, 0, 1, 1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(labels)], "s string, i long, y int")
    got = sorted(tuple(r) for r in segments.label_islands(df, ["s"], "i", "y").select("y", "start", "end").collect())
    assert got == [(0, 0, 2), (0, 3, 4), (1, 4, 6)]


@pytest.mark.parametrize("length,expected", [(9, 0), (10, 0), (11, 1), (14, 1), (15, 2)])
def test_centred_windows_stay_inside(spark, length, expected):
    isl = spark.createDataFrame([(0, length)], "start long, `end` long")
    got = segments.centred_windows(isl, 5, 4)
    assert got.count() == expected == len(range(5, length - 5, 4))
    assert isl.select(segments.centred_window_count(isl, 5, 4)).first()[0] == expected


def test_anchored_windows(spark):
    times = [0.0, 1.0, 1.9, 2.0, 3.9, 4.0]
    df = spark.createDataFrame([("a", t) for t in times], "s string, t double")
    got = segments.anchored_windows(df, ["s"], "t", 2.0, 1.0).groupBy("window_id").count().collect()
    want = {k: sum(k <= t < k + 2 for t in times) for k in range(3)}
    assert {r[0]: r[1] for r in got} == want
    assert segments.anchored_windows(df.filter("t < 1.5"), ["s"], "t", 2.0, 1.0).count() == 0


def test_mode_tie_is_smallest(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, None), (2, None)], "g int, y int")
    assert {r.g: r.label for r in segments.mode_label(df, ["g"], "y").collect()} == {1: 3, 2: None}


def test_gathered_equals_slices(spark):
    x = np.arange(100) * 0.5
    sig = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "s string, i long, v double")
    win = spark.createDataFrame([("a", 3, 20), ("a", 60, 140)], "s string, first long, last long")
    got = {r["first"]: list(r["values"]) for r in segments.gathered(win, sig, ["s"], "i", "v", 16).collect()}
    assert got == {3: list(x[3:20]), 60: list(x[60:100])}


def test_matched_segments_fallback(spark):
    a = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "s string, segment_id long")
    b = spark.createDataFrame([("a", 0)], "s string, segment_id long")
    got = {(r.s, r.segment_id): r.right_segment for r in segments.matched_segments(a, b, ["s"], "segment_id").collect()}
    assert got == {("a", 0): 0, ("a", 1): -1, ("b", 0): None}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 300])
def test_arrays_equal_numpy(spark, n):
    x = np.random.default_rng(n).normal(size=n).tolist()
    c = F.col("x")
    r = one(spark, x, "array<double>", A.mean(c), A.std(c), A.quantile(c, 0.25), A.slope(c), A.rmssd(c), A.downsampled(c, 20), A.peak_count(c), A.segments(c))
    a = np.array(x)
    if n:
        assert np.allclose([r.c0, r.c1, r.c2], [a.mean(), a.std(), np.percentile(a, 25)])
        assert [len(s) for s in r.c7] == [len(s) for s in np.array_split(a, min(4, n))]
    else:
        assert (r.c0, r.c1, r.c2, r.c7) == (None, None, None, [])
    assert r.c3 == (pytest.approx(np.polyfit(np.arange(n), a, 1)[0]) if n > 1 else None)
    assert r.c4 == (pytest.approx(np.sqrt((np.diff(a) ** 2).mean())) if n > 1 else None)
    pick = a[np.linspace(0, n - 1, 20).astype(int)] if n > 20 else a
    assert np.allclose(r.c5, pick)
    if n > 2:
        assert r.c6 == int(((a[1:-1] > a[:-2]) & (a[1:-1] > a[2:]) & (a[1:-1] > a.mean() + a.std())).sum())


def test_clean_drops_bad_cells(spark):
    assert one(spark, [0.1, None, float("nan"), float("inf"), 0.3], "array<double>", A.clean(F.col("x"))).c0 == [0.1, 0.3]


def test_periodicity_of_a_tone(spark):
    x = np.sin(np.arange(64) * 2 * np.pi / 8).tolist()
    assert one(spark, x, "array<double>", A.periodicity(F.col("x"))).c0 == "strong"
    assert one(spark, [1.0] * 64, "array<double>", A.periodicity(F.col("x"))).c0 == "weak or unclear"


def test_python_number_formats(spark):
    df = spark.createDataFrame([(0.0625,), (1234.5,), (None,)], "x double")
    assert [r[0] for r in df.select(formatted(F.col("x"), ".3f")).collect()] == ["0.062", "1234.500", "unavailable due to insufficient signal"]
    assert [r[0] for r in df.select(formatted(F.col("x"), ".4g", "-")).collect()] == ["0.0625", "1234", "-"]
    assert one(spark, [0.1234, 2.0], "array<double>", rounded_list(F.col("x"))).c0 == "[0.123, 2.0]"


@pytest.mark.parametrize("raw,want", [(" Stairs-Up ", "stairsup"), ("walking_downstairs", "stairsdown"), ("NaN", None), ("hop scotch", "hopscotch"), (None, None)])
def test_activity(spark, raw, want):
    assert one(spark, raw, "string", C.activity(F.col("x"))).c0 == want


@pytest.mark.parametrize("raw,want", [("REM", 1), ("W", 0), ("?", None), ("n-2", 1), ("other", None)])
def test_sleep(spark, raw, want):
    assert one(spark, raw, "string", C.sleep_wake(F.col("x"))).c0 == want


@pytest.mark.parametrize("scale,want", [(1.0, 1.0), (1e3, 1e3), (1e9, 1e9)])
def test_time_units(spark, scale, want):
    df = spark.createDataFrame([(i * 0.01 * scale,) for i in range(500)], "t double")
    assert C.seconds_divisor(df, "t") == want
    assert C.seconds_divisor(df.limit(1), "t") == 1.0


def test_natural_key(spark):
    names = ["S10", "S2", "s1", "S010b", "T"]
    got = spark.createDataFrame([(n,) for n in names], "x string").orderBy(C.natural_key(F.col("x")), "x").collect()
    assert [r.x for r in got] == recordings.natural(names)


def test_filters():
    rate = 100.0
    t = np.arange(0, 20, 1 / rate)
    low = dsp.zero_phase(dsp.design("butter", 4, 1.0, rate, "low"), np.sin(2 * np.pi * 0.2 * t) + np.sin(2 * np.pi * 20 * t))
    assert np.abs(low[300:-300] - np.sin(2 * np.pi * 0.2 * t)[300:-300]).max() < 0.02
    band = dsp.zero_phase(dsp.design("cheby2", 4, (0.5, 20.0), rate, "band"), 3 + np.sin(2 * np.pi * 5 * t))
    assert np.abs(band[300:-300] - np.sin(2 * np.pi * 5 * t)[300:-300]).max() < 0.15
    slow = dsp.design("butter", 4, (0.1, 0.35), 700.0, "band")
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in slow)


def test_known_butterworth_coefficients():
    s = dsp.design("butter", 2, 0.25, 1.0, "low")[0]  # half the Nyquist frequency
    assert np.allclose(s, [0.29289322, 0.58578644, 0.29289322, 1, 0, 0.17157288], atol=1e-7)


def test_spectrum_and_peaks():
    t = np.arange(0, 16, 1 / 64)
    assert dsp.peak_frequency(np.sin(2 * np.pi * 5 * t), 64) == pytest.approx(5, abs=0.26)
    f, p = dsp.welch(2 * np.sin(2 * np.pi * 4 * t), 64)
    assert dsp.trapezoid(p, f) == pytest.approx(2.0, rel=0.05)
    assert list(dsp.find_peaks(np.array([0, 1, 0, 2, 2, 0, 3, 0.0]))) == [1, 3, 6]
    assert list(dsp.find_peaks(np.array([0, 1, 0, 2, 0, 3, 0.0]), distance=3)) == [1, 5]
    assert np.isnan(dsp.snr_db(np.zeros(10), 64))


def test_heart_rate():
    rate, bpm = 64.0, 72
    t = np.arange(0, 60, 1 / rate)
    pulse = np.exp(-(((t * bpm / 60) % 1 - 0.5) ** 2) / 0.01)
    assert dsp.cardiac_features(pulse, rate, "bvp")["hr_mean"] == pytest.approx(bpm, abs=1.5)
    assert set(dsp.cardiac_features(pulse[:100], rate, "bvp").values()) == {None}
    for f in (dsp.eda_features, dsp.emg_features, dsp.resp_features):
        assert set(f([], 64.0).values()) == {None}
        assert any(v is not None for v in f(pulse + t / 100, 64.0).values())


ANSWERS = [
    ('{"predicted_state": 1}', 1, ""), ('```json\n{"predicted_state": 0}\n```', 0, ""), ('Sure: {"predicted_state": "1"} done', 1, ""),
    ("", None, "empty_response"), ("  ", None, "empty_response"), ("no", None, "invalid_json"), ("[1]", None, "json_not_object"), ("3", None, "json_not_object"),
    ('{"a": 1}', None, "missing_predicted_state"), ('{"predicted_state": null}', None, "non_integer_predicted_state"), ('{"predicted_state": "1.0"}', None, "non_integer_predicted_state"),
    ('{"predicted_state": 1.9}', 1, ""), ('{"predicted_state": true}', 1, ""), ('{"predicted_state": 7}', None, "out_of_label_space:7"),
    ('{"predicted_state": Infinity}', None, "non_integer_predicted_state"), ('{"predicted_state": NaN}', None, "non_integer_predicted_state"),
    ('{"predicted_state": 0} {"predicted_state": 1}', None, "invalid_json"), ('{"predicted_state": 0, "predicted_state": 1}', 1, ""), ("{'predicted_state': 1}", None, "invalid_json"), (None, None, "empty_response"),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, x string")
    got = df.select("i", answers.parsed(F.col("x"), [0, 1]).alias("p")).orderBy("i").collect()
    assert [(r.p.label, r.p.parse_error) for r in got] == [(a[1], a[2]) for a in ANSWERS]
    assert all(r.p.valid == (r.p.label is not None) for r in got)


def test_votes(spark):
    texts = ['{"predicted_label": 1}', '{"predicted_label": true}', 'x predicted_label = 0', '{"predicted_label": "1"', '{"predicted_label": 9}', None]
    assert [answers.vote(t, [0, 1]) for t in texts] == [1, None, 0, 1, None, None]
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 0), ("b", 1), ("c", None), ("d", 5)], "s string, v int")
    assert {r.s: r.majority_vote for r in metrics.majority(df, "s", "v", [0, 1]).collect()} == {"a": 1, "b": None}


def test_scores_without_rows_and_one_class(spark):
    empty = spark.createDataFrame([], "t int, p int")
    r = metrics.scores(empty, "t", "p", [0, 1]).first()
    assert (r.n, r.accuracy, r.macro_f1, r.weighted_f1) == (0, 0.0, 0.0, 0.0)
    r = metrics.scores(spark.createDataFrame([(1, 1), (1, 1)], "t int, p int"), "t", "p", [0, 1]).first()
    assert (r.accuracy, r.f1_1, r.macro_f1) == (1.0, 1.0, 0.5)


def test_usage_is_null_without_tokens(spark):
    cols = "s int, prompt_chars long, completion_chars long, total_chars long, prompt_tokens long, completion_tokens long, total_tokens long, elapsed_time_sec double"
    df = spark.createDataFrame([(1, 10, 2, 12, None, None, None, 0.5), (2, 10, 2, 12, 3, 1, 4, 0.5)], cols)
    per = metrics.folded_usage(df, "s")
    r = metrics.usage_summary(per).first()
    assert (r.total_tokens, r.sample_token_usage_available_count, r.average_total_tokens_per_sample) == (4, 1, 4.0)
    assert metrics.usage_summary(per.filter("s = 1")).first().total_tokens is None
    assert metrics.usage_summary(per.filter("s = 9")).first().total_llm_calls == 0


def pool(spark):
    rows = [(f"S{s}_{y}_{k}", f"S{s}", y, f"text {s} {y} {k}") for s in range(1, 7) for y in (0, 1) for k in range(2)]
    return spark.createDataFrame(rows, "sample_id string, subject string, label int, input_text string")


def test_leave_one_out(spark):
    p = pool(spark)
    good = sampling.complete_subjects(p, "subject", "label", [0, 1])
    found = sampling.other_subjects(p.filter("subject = 'S3'").select("subject").distinct(), good, "subject", 3, 42)
    shots = sampling.examples(found, p, "subject", "label", "sample_id", 1, 42).collect()
    assert len(shots) == 6 and "S3" not in {r.subject for r in shots}
    again = sampling.examples(found, p.repartition(7), "subject", "label", "sample_id", 1, 42).collect()
    assert sorted(shots) == sorted(again)


def test_shortages(spark):
    p = pool(spark)
    with pytest.raises(sampling.Shortage):
        sampling.label_balanced(p, "label", 100, 1, "sample_id")
    assert sampling.label_balanced(p, "label", 100, 1, "sample_id", True).count() == 24
    with pytest.raises(sampling.Shortage, match="shortage.*excess"):
        sampling.assert_balanced(p.filter("label = 0 and subject < 'S3' or label = 1"), "label", [0, 1], 6)
    with pytest.raises(ValueError, match="S2"):
        sampling.check_disjoint(["S1", "S2"], ["S2"])


def test_split_subjects():
    assert sampling.split_subjects(["S010", "S002", "S003"]) == (["S010"], ["S002", "S003"])
    assert sampling.split_subjects(["S010", "S002", "S003"], train=["S002"]) == (["S002"], ["S010", "S003"])
    assert sampling.split_subjects(["a", "b", ""], test=["a"]) == (["b"], ["a"])


def test_views_first_key_then_position(spark):
    base = spark.createDataFrame([("D", "s", 0, "k1", 0), ("D", "s", 1, None, 1)], "dataset string, subject string, label int, sample_id string, position int")
    view = spark.createDataFrame([("D", "s", 0, "k1", 7, "first"), ("D", "s", 0, "k1", 9, "second"), ("D", "s", 1, None, 1, "placed")], "dataset string, subject string, label int, sample_id string, position int, input_text string")
    got = {r.position: r.input_views for r in align.with_views(base, {"v": view}).collect()}
    assert got == {0: {"v": "first"}, 1: {"v": "placed"}}


def test_store(spark, tmp_path):
    root = str(tmp_path / "cache")
    store.save(pool(spark), root, store.Manifest("WESAD", "raw_data", [0, 1], {"stride_sec": 60.0}))
    m = store.load_manifest(spark, root)
    assert m.sample_count == 24 and m.label_distribution == {"0": 12, "1": 12} and m.subjects[0] == "S1"
    store.validate(m, "WESAD", "raw_data", {"stride_sec": 60.0 + 1e-12})
    with pytest.raises(ValueError):
        store.validate(m, "HHAR", None, {})
    with pytest.raises(store.StaleCache, match="stride_sec"):
        store.validate(m, "WESAD", None, {"stride_sec": 30.0})
    with pytest.raises(Exception, match="(?i)exist"):
        store.save(pool(spark), root, store.Manifest("WESAD"))
    assert store.load(spark, root, ["S2"], [1]).count() == 2 and store.load(spark, root, []).count() == 24
    layered = store.Manifest("X", source={"subset": {"source_processed": {"loader_kwargs": {"a": 1}}}}, loader_kwargs={"a": 2})
    assert layered.loader_settings() == {"a": 1}


def test_config_expansion(tmp_path):
    f = tmp_path / "c.json"
    f.write_text("﻿" + json.dumps({"base": {"dataset": "WESAD", "cost": {"a": 1}}, "grid": {"input": ["raw", "feature"], "cost.b": [2, 3]}}), encoding="utf-8")
    got = experiment.expanded(experiment.load_config(str(f)))
    assert len(got) == 4 and got[0]["cost"] == {"a": 1, "b": 2} and got[3]["input"] == "feature"
    assert len(experiment.matrix()) == 72 and len({e.name for e in experiment.matrix()}) == 72
    with pytest.raises(ValueError):
        experiment.Experiment(input="nothing")


@pytest.mark.parametrize("usage", experiment.USAGES)
def test_experiment_with_mock(spark, tmp_path, usage):
    rows = pool(spark).withColumn("input_views", F.create_map(F.lit("raw_data"), F.col("input_text")))
    call = MockScorer(key="predicted_state")
    e = experiment.Experiment("WESAD", "raw", usage, "label_explanation", balanced_per_label=4)
    got, scores = experiment.run(e, rows, call, str(tmp_path))
    assert got.count() == 8 and got.filter("valid").count() == 8 and scores.first().n == 8


def test_prompts_do_not_leak(spark):
    rows = pool(spark).limit(1)
    text = rows.select(prompts.direct("HHAR", [0, 1], "raw_data", F.col("input_text"))).first()[0]
    assert text.startswith("You are given one time-series sample") and '"predicted_state": 0 or 1' in text
    shown = rows.withColumn("original_state", F.lit("STRESS")).select(agents.metadata(["subject", "label", "original_state"])).first()[0]
    assert "STRESS" not in shown and "label" not in shown


def test_rendering(spark):
    sig = "array<struct<name:string,x:array<double>,y:array<double>,z:array<double>>>"
    x = [float(i % 5) for i in range(100)]
    df = spark.createDataFrame([([("eda", x, None, None), ("acc", x, x, x)],)], f"s {sig}")
    text = df.select(render.raw_block(F.col("s"), F.lit("HHAR"))).first()[0]
    assert text.split("\n")[0] == "Input raw sequences:" and text.index("acc = {") < text.index("eda = [") and len(json.loads(text.split("eda = ")[1])) == 48
    assert "chest_ecg = []" in df.select(render.raw_block(F.col("s"), F.lit("WESAD"))).first()[0]
    one_channel = spark.createDataFrame([([("EDA", "EDA", "wrist", 4.0, x)],)], "c array<struct<channel:string,sensor:string,place:string,rate:double,x:array<double>>>")
    block = one_channel.withColumn("s", render.supporting(F.col("c"))).select(F.zip_with("c", "s", render.encoded_channel).alias("b")).first().b[0]
    assert block.startswith("<WRIST_EDA_CHANNEL>") and "Sampling rate: 4 Hz" in block and block.endswith("</WRIST_EDA_CHANNEL>")
    with pytest.raises(ValueError):
        render.with_knowledge(F.lit("x"), " ")


def test_motion_log(spark, tmp_path):
    f = tmp_path / "acc.csv"
    head = "Creation_Time,x,y,z,User,Model,Device,gt\n"
    f.write_text(head + "".join(f"{i * 10_000_000},{i},1,2,a,m,d,stairsup\n" for i in range(600)) + "1,x,1,1,a,m,d,stairsup\n1,1,1,1,a,m,d,sit\n")
    df = recordings.read_motion(spark, str(f))
    assert df.count() == 600 and df.agg(F.max("time_sec")).first()[0] == pytest.approx(5.99)
    w = recordings.motion_windows(df, df)
    rows = w.orderBy("window_id").collect()
    assert [r.window_id for r in rows] == [0, 1, 2, 3]
    assert all(len(r.x) == 20 and len(r.gx) == 20 for r in rows)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        recordings.read_motion(spark, str(tmp_path / "bad.csv"))


def test_overnight_log(spark, tmp_path):
    f = tmp_path / "S002_whole_df.csv"
    f.write_text("TIMESTAMP,BVP,TEMP,Sleep_Stage\n" + "".join(f"{i / 4},{i % 7},{20 + i},{'W' if i < 80 else 'N2'}\n" for i in range(160)))
    df = recordings.read_overnight(spark, [str(f)], 4.0)
    assert df.agg(F.min("skin_temp"), F.max("skin_temp")).first()[:] == (31.0, 40.0)
    got = recordings.overnight_windows(df, 4.0, 10.0).orderBy("window_id").collect()
    assert [r.label for r in got] == [0, 0, 1] and len(got[0].bvp) == 40 and got[0].subject == "S002"


def test_stress_recording(spark, tmp_path):
    import pickle

    n = 20
    sig = {"chest": {"ECG": np.arange(700 * n), "ACC": np.ones((700 * n, 3))}, "wrist": {"BVP": np.arange(64 * n), "TEMP": np.arange(4 * n)}}
    label = np.r_[np.zeros(700 * 2), np.ones(700 * 8), np.full(700 * 10, 2)]
    (tmp_path / "S2").mkdir()
    with open(tmp_path / "S2" / "S2.pkl", "wb") as out:
        pickle.dump({"signal": sig, "label": label}, out)
    signals, labels = recordings.read_stress(spark, str(tmp_path))
    w = recordings.stress_windows(signals, labels, 4.0, 2.0, 2.0)
    rows = w.collect()
    assert {r.label for r in rows} == {0, 1}
    sizes = {(r.channel, r.axis): len(r["values"]) for r in rows}
    assert sizes == {("chest_ecg", None): 2800, ("chest_acc", "x"): 1400, ("chest_acc", "y"): 1400, ("chest_acc", "z"): 1400, ("wrist_bvp", None): 256, ("wrist_temp", None): 16}


def test_question_files_and_telemetry(spark, tmp_path):
    good = tmp_path / "q.json"
    good.write_text(json.dumps({"dataset": [{"subject": "a", "label": 1}, {"subject": "b", "label": 0}]}))
    assert recordings.read_questions(spark, str(good)).count() == 2
    bad = tmp_path / "b.json"
    bad.write_text(json.dumps([{"subject": "a", "qa_pair": {"A": "1"}}]))
    with pytest.raises(ValueError):
        recordings.read_questions(spark, str(bad))
    gpu = tmp_path / "g.csv"
    gpu.write_text("timestamp, index, utilization.gpu [%], power.draw [W]\n1, 0, 50 %, 100.5 W\n2, 0, 70 %, [N/A]\n")
    r = recordings.gpu_summary(recordings.read_gpu(spark, str(gpu))).first()
    assert (r.avg_utilization_gpu, r.max_power_draw, r.avg_memory_used) == (60.0, 100.5, None)
    log = tmp_path / "t.json"
    log.write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 1, "eval_f1": 0.5}, {"step": 2, "eval_f1": 0.7}, {"step": 3, "eval_f1": 0.6}]}))
    assert recordings.read_trainer_state(spark, str(log)).first().step == 2


def test_stream_equals_batch(spark, tmp_path):
    from sensorloom.streaming import windows as streaming

    rows = [("a", t, float(t)) for t in range(0, 100, 3)] + [("b", t, 1.0) for t in (5, 50)]
    df = spark.createDataFrame(rows, "s string, sec long, v double").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = streaming.anchored(stream, "s", "ts", "v", 20.0, 10.0, "1 hour").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.s, r.window_id): r.n for r in spark.table("w").collect()}
    batch = segments.anchored_windows(df.withColumn("t", F.col("ts").cast("double")), ["s"], "t", 20.0, 10.0)
    assert got == {(r.s, r.window_id): r["count"] for r in batch.groupBy("s", "window_id").count().collect()}
