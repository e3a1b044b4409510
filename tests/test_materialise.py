"""From recordings to texts, and the operators on the way."""

import json
import pickle
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom import cli
from sensorloom.functions import dsp
from sensorloom.operators import fingerprints, sampling
from sensorloom.plans import channels, experiment, features, knowledge, materialise
from sensorloom.sources import discovery, recordings, store

HEAD = "Creation_Time,x,y,z,User,Model,Device,gt\n"


def motion_files(root):
    (root / "deep").mkdir(parents=True)
    rows = [f"{i * 10_000_000},{i % 9},{i % 4},2,{u},m,d,{gt}\n" for u in "ab" for gt in ("stairsup", "stairsdown") for i in range(900)]
    (root / "Phones_accelerometer.csv").write_text(HEAD + "".join(rows))
    (root / "deep" / "Phones_gyroscope.csv").write_text(HEAD + "".join(rows))


@pytest.mark.parametrize("kind", ["raw_data", "feature_description", "embedding", "knowledge"])
def test_motion_to_texts(spark, tmp_path, kind):
    motion_files(tmp_path / "in")
    made = materialise.from_raw(spark, "hhar", str(tmp_path / "in"), str(tmp_path / "out"), [kind])
    n = made["windows"].sample_count
    assert n > 10 and made[kind].sample_count == n and made[kind].subjects == ["a", "b"]
    rows = store.load(spark, str(tmp_path / "out" / kind)).collect()
    assert {r.input_type for r in rows} == {experiment.INPUTS[kind]} and len({r.sample_id for r in rows}) == n
    words = {"raw_data": "acc = {", "feature_description": "- acc_magnitude: mean=", "embedding": "<MOBILE_DEVICE_GYRO_X_CHANNEL>", "knowledge": "[Decision Guidance]"}
    assert all(words[kind] in r.input_text for r in rows)


def test_views_and_subsets(spark, tmp_path):
    motion_files(tmp_path / "in")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    materialise.from_raw(spark, "HHAR", root, out, ["raw_data"])
    samples, _ = materialise.union(spark, [f"{out}/windows", f"{out}/windows"])
    assert samples.count() == 2 * store.load(spark, f"{out}/windows").count()
    own = store.load(spark, f"{out}/windows")
    rows = materialise.views(own, "HHAR", ["raw", "feature", "raw_data"]).collect()
    assert all(set(r.input_views) == {"raw_data", "feature_description"} for r in rows) and len(rows) == own.count()
    whole = materialise.views(own, "HHAR", ["raw", "feature", "knowledge", "embedding"], text="More.")
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    alone = {k: {r.sample_id: r.input_text for r in materialise.texts(own, "HHAR", k, **({"text": "More."} if k == "knowledge" else {})).collect()} for k in ("raw", "feature", "knowledge", "embedding")}
    for r in whole.collect():
        assert r.input_views == {experiment.INPUTS[k]: alone[k][r.sample_id] for k in alone}
    made = materialise.save_subset(spark, [f"{out}/raw_data"], "debug", f"{out}/subsets")
    assert made.sample_count == 6 and made.source["subset"]["digest"] and made.label_distribution == {"0": 3, "1": 3}
    with pytest.raises(FileNotFoundError, match="incomplete"):
        materialise.union(spark, [f"{out}/windows", f"{out}/none"])
    with pytest.raises(sampling.Shortage):
        materialise.subset(own, "HHAR", "main")


def test_sleep_to_texts(spark, tmp_path):
    rate, n = 16, 16 * 130
    t = np.arange(n) / rate
    rows = "".join(f"{a},{np.sin(7 * a) * 20 + i % 3},{60 + i % 5},{5 + np.sin(a / 9)},{20 + i % 30},{i % 2},{i % 3},1,{'W' if i < n / 2 else 'N2'}\n" for i, a in enumerate(t))
    (tmp_path / "data_64Hz").mkdir()
    (tmp_path / "data_64Hz" / "S002_whole_df.csv").write_text("TIMESTAMP,BVP,HR,EDA,TEMP,ACC_X,ACC_Y,ACC_Z,Sleep_Stage\n" + rows)
    got = materialise.sleep_samples(spark, str(tmp_path), subjects=["S002", "S9"], seconds=30.0, share=0.2)
    made = {r.sample_id: r for r in got.collect()}
    assert sorted(made) == [f"DREAMT_S002_{i}" for i in range(4)] and [made[f"DREAMT_S002_{i}"].label for i in range(4)] == [0, 0, 1, 1]
    names = {s.name for s in made["DREAMT_S002_0"].signals}
    assert names == {"bvp", "bvp_filt", "eda", "eda_lowpass", "hr", "temp", "skin_temp", "actigraphy", "acc"}
    texts = materialise.texts(got, "DREAMT", "feature_description").collect()
    assert all("- sleep_stillness_ratio: " in r.input_text and "Electrodermal activity:" in r.input_text for r in texts)


def test_stress_to_texts(spark, tmp_path):
    n = 130
    sig = {"chest": {"ECG": np.sin(np.arange(700 * n) / 90), "ACC": np.ones((700 * n, 3)), "EDA": np.sin(np.arange(700 * n) / 9000)}, "wrist": {"TEMP": np.arange(4.0 * n)}}
    (tmp_path / "S2").mkdir()
    with open(tmp_path / "S2" / "S2.pkl", "wb") as out:
        pickle.dump({"signal": sig, "label": np.full(700 * n, 2)}, out)
    assert discovery.stress_subjects(spark, str(tmp_path)) == ["S2"]
    with pytest.raises(FileNotFoundError, match="S7"):
        discovery.stress_subjects(spark, str(tmp_path), ["S7"])
    got = materialise.stress_samples(spark, str(tmp_path))
    rows = materialise.texts(got, "WESAD", "feature_description").collect()
    assert rows and all("Chest ECG/HRV:" in r.input_text and "wrist_temp_slope=" in r.input_text and "Wrist BVP" not in r.input_text for r in rows)
    assert all("chest_ecg = [" in r.input_text for r in materialise.texts(got, "WESAD", "raw_data").collect())


def test_command_line(spark, tmp_path, capsys):
    motion_files(tmp_path / "in")
    out = str(tmp_path / "out")
    assert cli.main(["windows", "--dataset", "HHAR", "--root", str(tmp_path / "in"), "--out", out]) == 0
    assert cli.main(["texts", "--cache", f"{out}/windows", "--input", "knowledge", "--knowledge-text", "More.", "--out", f"{out}/texts"]) == 0
    assert cli.main(["count", "--cache", f"{out}/texts"]) == 0
    assert "a\t0\t" in capsys.readouterr().out.replace("'", "")
    assert all("[External Knowledge]\nMore." in r.input_text for r in store.load(spark, f"{out}/texts").collect())


def signals_frame(spark, rows):
    """Rows of ``{name: axes}``."""
    made = [(i, [(n, *(list(map(float, a)) for a in axes), *[None] * (3 - len(axes))) for n, axes in r.items()]) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, f"i int, signals {features.SIGNALS}")


def test_stress_features_have_their_names(spark):
    t = lambda r: np.arange(60 * r) / r
    signals = {n: tuple(3 * np.sin(7 * t(r)) + np.sin(0.25 * 6.28 * t(r)) + j for j in range(3 if k == "acc" else 1)) for n, k, r in dsp.STRESS}
    rows = [signals, {"chest_ecg": ([],)}, {"chest_acc": ([1.0],) * 3}, {"wrist_acc": ([1.0] * 20, [1.0] * 20, [1.0] * 19), "odd": ([1.0],)}, {}]
    got, ecg, short, uneven, none = (r.f for r in features.with_stress_features(signals_frame(spark, rows), out="f").orderBy("i").collect())
    per = {"acc": dsp.ACC, "ecg": dsp.HRV_TIME + dsp.HRV_POWER, "bvp": dsp.HRV_TIME + dsp.HRV_POWER, "eda": dsp.EDA, "emg": dsp.EMG, "resp": dsp.RESP, "temp": dsp.TEMP}
    assert set(got) == {f"{n.split('_')[0]}_{f}" for n, k, _ in dsp.STRESS for f in per[k]}
    text = features.with_feature_text(signals_frame(spark, rows[:1]), "WESAD").first().input_text
    assert re.findall(r"(\w+)=", text) == [f"{n.split('_')[0]}_{f}" for n, k, _ in dsp.STRESS for f in per[k]]
    assert got["chest_resp_rate"] == pytest.approx(15, abs=0.5) and got["wrist_acc_x_peak_freq"] == pytest.approx(7 / 6.28, abs=0.3)
    assert ecg == none == {} and set(short.values()) == {None} and len(short) == len(dsp.ACC) and set(uneven.values()) == {None}
    x, y, z = (dsp.centre(np.array(a), 5 * 32) for a in signals["wrist_acc"])
    size = np.sqrt(x**2 + y**2 + z**2)
    area = lambda v: dsp.trapezoid(np.abs(v), np.arange(len(v)) / 32)
    want = {"y_mean": y.mean(), "z_std": z.std(), "x_abs_int": area(x), "y_peak_freq": dsp.peak_frequency(y, 32), "3d_mean": size.mean(), "3d_std": size.std(), "3d_abs_int": area(size)}
    assert all(got[f"wrist_acc_{k}"] == pytest.approx(v) for k, v in want.items())
    v = np.array(signals["chest_temp"][0])
    want = {"mean": v.mean(), "std": v.std(), "min": v.min(), "max": v.max(), "range": np.ptp(v), "slope": np.polyfit(t(700), v, 1)[0]}
    assert all(got[f"chest_temp_{k}"] == pytest.approx(w) for k, w in want.items())


def test_stress_texts(spark):
    values = {"chest_hr_mean": None, "odd": 1.0, "chest_acc_x_mean": 0.00012345, "chest_acc_y_mean": 1e9} | {f"wrist_eda_{i}": float(i) for i in range(5)}
    df = spark.createDataFrame([(0, list(values), list(values.values())), (1, [], []), (2, None, None)], "i int, k array<string>, v array<double>").orderBy("i")
    df = df.select("i", F.map_from_arrays("k", "v").alias("f"))  # a map from Python has no order
    got, empty, null = (r[0] for r in df.withColumn("s", features.printed_values(F.col("f"))).select(features.stress_text(F.col("s"))).collect())
    assert got.splitlines() == [
        features.TITLES["WESAD"], "", "Chest ACC:", "- chest_acc_x_mean=0.0001234, chest_acc_y_mean=1e+09", "", "Chest ECG/HRV:", "- chest_hr_mean=unavailable due to insufficient signal", "",
        "Wrist EDA/SCR:", "- wrist_eda_0=0, wrist_eda_1=1, wrist_eda_2=2, wrist_eda_3=3", "- wrist_eda_4=4", "", "Other:", "- odd=1",
    ]
    assert empty == null == f"{features.TITLES['WESAD']}\n- no WESAD signal features available"


def sleep_cues(signals):
    """The cues by NumPy: of the first channel of a name, or else whose name holds it."""
    out = {}
    key = lambda n: n.replace("-", "_").replace(" ", "_").strip().lower()

    def first(*names):
        hits = [s for n in names for k, s in signals.items() if key(k) == n] + [s for k, s in signals.items() if any(n in key(k) for n in names)]
        flats = [np.ravel(s, "F") if len({*map(len, s)}) == 1 else np.concatenate(s) for s in hits]
        return next((np.asarray(f, float) for f in flats if len(f)), None)

    axes = [first(*(f"{p}_{k}" for p in ("acc", "accelerometer", "actigraphy"))) for k in "xyz"]
    n = 0 if any(a is None for a in axes) else min(map(len, axes))
    series = {"acc_magnitude": np.sqrt(sum(a[:n] ** 2 for a in axes)) if n else first("actigraphy", "activity", "motion")}
    series |= {p: first(*names) for p, names, _ in features._CUES}
    for p, x in series.items():
        if x is None:
            continue
        out |= {f"{p}_mean": x.mean(), f"{p}_std": x.std(), f"{p}_range": np.ptp(x)}
        if p not in ("acc_magnitude", "ibi") and len(x) > 1:
            out[f"{p}_slope"] = np.polyfit(np.arange(len(x)), x, 1)[0]
        if p == "acc_magnitude":
            d = np.abs(np.diff(x))
            limit = np.median(d) + d.std() if len(d) else 0
            far = d > (limit if limit > 0 else 1e-8)
            out |= {"movement_count": far.sum(), "stillness_ratio": 1 - far.mean() if len(d) else 1.0}
        if p == "ibi" and len(x) > 1:
            out["ibi_rmssd"] = np.sqrt((np.diff(x) ** 2).mean())
        if p in ("bvp", "eda"):
            out[f"{p}_peak_count"] = ((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:]) & (x[1:-1] > x.mean() + x.std())).sum()
    return dict(sorted(out.items()))


def test_sleep_cues_equal_numpy(spark):
    rng = np.random.default_rng(3)
    v = lambda n: rng.normal(size=n)
    rows = [
        {"acc_x": (v(20),), "acc_y": (v(18),), "acc_z": (v(20),), "HR": (v(9),), "ibi": (v(7),), "bvp": (v(60),), "eda": (v(40),), "skin-temp": (v(5),)},
        {"actigraphy": (v(1),), "my hr": (v(1),), "ibi raw": (v(1),), "gsr": (v(2),)}, {"acc": (v(6), v(6), v(6)), "temperature": ([],), "temp 2": (v(3),), "ppg_a": (v(4), v(4), v(4)), "pulse": (v(3), v(2), v(1))},
        {"heart rate": ([1.0] * 5,), "motion": ([2.0] * 6,)}, {"other": (v(3),)},
    ]
    got = [[(c.name, c.value) for c in r.c] for r in signals_frame(spark, rows).orderBy("i").select(features.sleep_features(F.col("signals")).alias("c")).collect()]
    for have, signals in zip(got, rows):
        want = sleep_cues(signals)
        assert [k for k, _ in have] == list(want) and np.allclose([x for _, x in have], list(want.values()), atol=1e-9)


def test_feature_texts(spark):
    rows = [{"light": ([1.0, 2.0],), "acc": ([3.0, 4.0],) * 3, "gyro_mag": ([],), "x": ([0.0625],)}, {}, {"odd": ([1.0],)}]
    df = signals_frame(spark, rows).orderBy("i")
    motion = [r.input_text for r in features.with_feature_text(df, "hhar").collect()]
    plain = [r.input_text for r in features.with_feature_text(df).collect()]
    one = lambda n, a, s, lo, hi, p, q, t: f"- {n}: mean={a}, std={s}, min={lo}, max={hi}, p25={p}, p75={q}, trend={t}"
    acc = [one(f"acc_{k}", "3.500", "0.500", "3.000", "4.000", "3.250", "3.750", "increasing") for k in "xyz"]
    size = one("acc_magnitude", "6.062", "0.866", "5.196", "6.928", "5.629", "6.495", "increasing")
    gone = one("gyro_mag", *["unavailable due to insufficient signal"] * 6, "empty")
    x = one("x", "0.062", "0.000", "0.062", "0.062", "0.062", "0.062", "relatively stable")
    assert motion[0].splitlines() == [features.TITLES["HHAR"], "", "Accelerometer:", *acc, size, x, "", "Gyroscope:", gone]
    assert plain[0].splitlines() == [features.TITLE, *acc, size, gone, one("light", "1.500", "0.500", "1.000", "2.000", "1.250", "1.750", "increasing"), x]
    assert motion[1] == motion[2] == f"{features.TITLES['HHAR']}\n- no numeric signals available" and plain[1].endswith("- no numeric signals available")
    with pytest.raises(Exception, match="no wearable sleep signal among: odd"):
        features.with_feature_text(df.filter("i = 2"), "DREAMT").collect()


def test_resampling_keeps_tones():
    t = np.arange(240) / 4
    x = np.sin(2 * np.pi * 0.5 * t) + 3
    assert np.allclose(dsp.resampled(x, 240 * 16), np.sin(2 * np.pi * 0.5 * np.arange(240 * 16) / 64) + 3, atol=1e-9)


def test_fingerprints_are_python_json(spark):
    rows = [("d", 'q"\\\n', 1, "s1", 3.0, None), ("d", "é", 0, None, 2.5, 7), ("d", "n", 0, None, None, None)]
    df = spark.createDataFrame(rows, "dataset string, subject string, label int, sample_id string, window_start double, epoch_id int")
    got = [r[0] for r in df.select(fingerprints.fingerprint(df)).collect()]
    for text, r in zip(got, rows):
        parts = dict(zip(("dataset", "subject", "label", "sample_id", "window_start", "epoch_id"), r))
        want = {k: v for k, v in parts.items() if v is not None}
        if len(want) == 3:
            assert len(json.loads(text)["signals_sha256"]) == 64
        else:
            assert text == json.dumps(want, sort_keys=True, ensure_ascii=False)
    shots = df.withColumn("input_text", F.lit("x"))
    assert all(len(json.loads(r[0])["input_sha256"]) == 64 for r in shots.select(fingerprints.fingerprint(shots, fingerprints.EXAMPLE, "input_text")).collect())
    assert fingerprints.ranked_by_fingerprint(df, ["label"], 1, 42, "t").count() == 2


def test_knowledge_modes(spark, tmp_path):
    show = lambda *a, **k: spark.range(1).select(knowledge.knowledge_text(F.lit(" f "), *a, **k)).first()[0]
    assert show("WESAD").startswith("[Current Sample Feature Description]\nf\n\n[Dataset Context]\nThis dataset") and "[External" not in show("WESAD", "x", mode="default")
    path = tmp_path / "k.txt"
    path.write_text("from file\n", encoding="utf-8")
    assert "[External Knowledge]\nfrom file\n\ninline\n\n[Decision" in show("HHAR", "inline", str(path))
    replaced = show(None, "only", mode="replace")
    assert "[Dataset / Channel" not in replaced and "External knowledge supplied for this run." in replaced
    for bad in (("WESAD", "", None, "replace"), ("WESAD", "", None, "odd"), ("other",)):
        with pytest.raises(ValueError):
            show(*bad)
    with pytest.raises(FileNotFoundError):
        show("WESAD", "", str(tmp_path / "none"))
    e = spark.createDataFrame([([(1, "s", 0.5), (None, None, None)],), ([],)], "e array<struct<label:int,feature_summary:string,similarity_score:double>>")
    got = [r[0] for r in e.select(knowledge.knowledge_text(F.lit("f"), "HHAR", examples=F.col("e"))).collect()]
    assert got[0].endswith("- Retrieved example 1: label=1; feature_summary=s; similarity_score=0.5\n- Retrieved example 2: retrieved example metadata unavailable")
    assert "Retrieved" not in got[1]


def test_channels(spark):
    names = ["z", "acc", "eda", "a"]
    got = spark.range(1).select(channels.ordered(F.array(*map(F.lit, names)), ["eda", "none", "acc"])).first()[0]
    assert got == ["eda", "acc", "a", "z"]
    one = lambda n, d, **m: spark.range(1).select(channels.described(channels.channel_key(F.lit(n)), d, **m)).first()[0]
    assert one("Chest-EDA", "WESAD")[:] == ("EDA", "electrodermal activity", "chest", 700.0) and one("odd", "WESAD") is None
    assert one("My Ch", None, more={"my-ch": {"name": "N", "location": "hand"}})[:] == ("N", "unknown", "hand", None)


def test_artifacts_and_filters(spark):
    rows = [(float(i) / 64, "s", float(600 if i == 5 else i % 7), float(i % 2)) for i in range(64 * 60)]
    df = spark.createDataFrame(rows, "t double, subject string, bvp double, acc_x double").withColumn("label", F.lit(1))
    got = recordings.overnight_windows(recordings.filtered(df), 64.0, 30.0).orderBy("window_id").collect()
    assert got[0].artifact and len(got[0].bvp_filt) == 1920 and len(got[0].acc_x_filt) == 1920
    assert np.allclose(np.array(got[0].bvp_filt), dsp.cheby2_band(np.array([r[2] for r in rows]), 64.0, 0.5, 20.0)[:1920])
