"""Runs: whose examples are shown, who is evaluated, what a client is given, what a run costs."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sensorloom import cli
from sensorloom.operators import fingerprints, metrics, sampling
from sensorloom.plans import experiment
from sensorloom.sources import recordings, store
from tests.test_materialise import motion_files

POOL = "dataset string, subject string, label int, sample_id string, epoch_id int, input_text string"


def digest(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def shown(r):
    """An example's identity, as Python's JSON writes it."""
    parts = {"dataset": r[0], "subject": r[1], "label": r[2], "input_sha256": hashlib.sha256(r[5].encode()).hexdigest()}
    parts |= {k: v for k, v in (("sample_id", r[3]), ("epoch_id", r[4])) if v is not None}
    return json.dumps(parts, sort_keys=True, ensure_ascii=False)


def pool_rows():
    rng = random.Random(5)
    return [("WESAD", f"S{s}", y, None if rng.random() < 0.4 else f"S{s}-{y}-{k}", rng.choice([None, k]), f"text {s} {y} {k}\t\"é\"") for s in range(1, 8) for y in (0, 1) for k in range(rng.randint(1, 4))]


def test_leave_one_out_examples_by_fingerprint(spark):
    """Samples with and without a key; the choice depends on the evaluated subject as well."""
    rows = pool_rows()
    pool = spark.createDataFrame(rows, POOL).repartition(5)
    good = sampling.complete_subjects(pool, "subject", "label", [0, 1])
    found = sampling.other_subjects(pool.select("subject").distinct(), good, "subject", 3, 42)
    got = {}
    for r in fingerprints.leave_one_out(found, pool, "subject", "label", 2, 42).collect():
        got.setdefault(r.eval_subject, []).append((r.subject_rank, r.label, r.rn, r.input_text))
    for who in {r[1] for r in rows}:
        subjects = sorted({r[1] for r in rows} - {who}, key=lambda s: digest(42, "few-shot-subject", who, s))[:3]
        want = []
        for rank, s in enumerate(subjects, 1):
            for y in (0, 1):
                own = sorted((r for r in rows if r[1] == s and r[2] == y), key=lambda r: digest(42, "few-shot-sample", who, s, y, shown(r)))
                want += [(rank, y, i, r[5]) for i, r in enumerate(own[:2], 1)]
        assert sorted(got[who]) == want


def test_class_balanced_examples_by_fingerprint(spark):
    rows = pool_rows()
    pool = spark.createDataFrame(rows, POOL)
    got = [r.input_text for r in fingerprints.class_balanced(pool.repartition(3), "label", [0, 1], 3, 7).orderBy("place").collect()]
    picked = [r for y in (0, 1) for r in sorted((r for r in rows if r[2] == y), key=lambda r: digest(7, "class-balanced", y, shown(r)))[:3]]
    assert got == [r[5] for r in sorted(picked, key=lambda r: digest(7, "class-balanced-output", shown(r)))]
    with pytest.raises(sampling.Shortage, match="2: 0"):
        fingerprints.class_balanced(pool, "label", [0, 2], 3, 7)


def test_values_are_printed_as_python_does(spark):
    rng = random.Random(8)
    plain = [0.0, 1e-4, 9.999e-5, 1e16, 123456789.125, 1e15 + 0.5, 1.7976931348623157e308, -2.5e-7, 0.1 + 0.2, 1e22, 3.0, -7.0, 100.0, 1e-3, 12345678.9]
    plain += [round(rng.uniform(0, 50), 3) for _ in range(200)] + [rng.randint(1, 999) * 10.0**k for k in range(-30, 30)]
    odd = [5e-324, *(struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(300))]
    texts = ["a\tb\r\n\x08\x0c", "\x00\x0b\x1f\x1a\x7f", 'q"\\/', "é 😀", ""]
    rows = [("d", "s", 1, rng.choice(texts), d) for d in plain + odd if d == d] + [("d", t, 0, t, None) for t in texts]
    df = spark.createDataFrame(rows, "dataset string, subject string, label int, sample_id string, window_start double")
    got = [r[0] for r in df.select(fingerprints.fingerprint(df)).collect()]
    for text, r in zip(got, rows):
        want = {k: v for k, v in zip(("dataset", "subject", "label", "sample_id", "window_start"), r) if v is not None}
        assert json.loads(text) == want
        if r[4] not in odd:
            assert text == json.dumps(want, sort_keys=True, ensure_ascii=False)


@pytest.mark.parametrize("given,train,test", [
    ({}, ["a"], ["b", "c"]), ({"test_subjects": ["c"]}, ["a", "b"], ["c"]), ({"train_subjects": ["b"]}, ["b"], ["a", "c"]), ({"subjects": ["b"]}, None, ["b"]),
    ({"subjects": ["b", "c"], "usage": "few_shot"}, ["b"], ["c"]), ({"subject_split": "all"}, None, None), ({"subject_split": "all", "subjects": ["a"]}, None, ["a"]),
    ({"subject_split": "all", "usage": "few_shot", "example_selection": "class-balanced"}, ["a"], ["b", "c"]), ({"subject_split": "all", "usage": "few_shot"}, None, None),
    ({"subjects": ["a", "b"], "test_subjects": ["b"]}, ["a"], ["b"]),
])
def test_subjects_of_a_run(given, train, test):
    assert experiment.Experiment(**given).resolved_subjects(["a", "b", "c"]) == (train, test)


def test_subjects_that_do_not_fit():
    with pytest.raises(ValueError, match="split"):
        experiment.Experiment(subject_split="some").resolved_subjects(["a", "b"])
    with pytest.raises(ValueError, match="train and test"):
        experiment.Experiment(train_subjects=["a"], test_subjects=["a"]).resolved_subjects(["a", "b"])
    with pytest.raises(ValueError, match="two subjects"):
        experiment.Experiment().resolved_subjects(["a"])
    with pytest.raises(ValueError, match="selection"):
        experiment.Experiment(example_selection="any")


@pytest.mark.parametrize("input_type,usage,output,want", [
    ("feature", "direct", "label", (300, 128, 2, None)), ("raw", "direct", "label", (600, 128, 1, 800)), ("embedding", "few_shot", "label_explanation", (600, 256, 1, 800)),
    ("feature", "multi_agent", "label", (1200, 128, 2, None)), ("knowledge", "few_shot", "label", (600, 128, 1, 800)),
])
def test_defaults_by_input_and_usage(input_type, usage, output, want):
    e = experiment.Experiment(input=input_type, usage=usage, output=output)
    assert (e.client["timeout"], e.client["max_tokens"], e.examples_per_class, e.example_max_chars) == want
    own = experiment.Experiment(input=input_type, examples_per_class=5, example_max_chars=None)
    assert (own.examples_per_class, own.example_max_chars) == (5, None)


def test_a_profile_is_one_row(spark, tmp_path):
    gpu = tmp_path / "g.csv"
    gpu.write_text("timestamp, utilization.gpu [%], memory.used [MiB], memory.total [MiB]\n1, 50 %, 100 MiB, 200 MiB\n2, 70 %, 120 MiB, 200 MiB\n")
    one = lambda **k: spark.range(1).select(*(F.lit(v).alias(n) for n, v in k.items()))
    got = metrics.cost_profile(one(total_tokens=5), one(accuracy=0.5), recordings.gpu_summary(recordings.read_gpu(spark, str(gpu)))).collect()
    assert len(got) == 1 and (got[0].accuracy, got[0].total_tokens, got[0].gpu_samples, got[0].average_gpu_utilization_pct, got[0].memory_total_mib, got[0].max_power_w) == (0.5, 5, 2, 60.0, 200.0, None)
    assert metrics.cost_profile(one(a=1), one(b=2)).columns == ["b", "a"]


def test_runs_from_the_command_line(spark, tmp_path):
    motion_files(tmp_path / "in")
    out = str(tmp_path / "out")
    assert cli.main(["windows", "--dataset", "HHAR", "--root", str(tmp_path / "in"), "--out", out, "--input", "feature"]) == 0
    gpu = tmp_path / "g.csv"
    gpu.write_text("utilization.gpu [%]\n40 %\n")
    config = {"base": {"dataset": "HHAR", "input": "feature", "subjects": ["a", "b"], "per_subject_limit": 6, "cost": {"input": 1.0, "output": 2.0, "samples": 100}}, "experiments": [
        {"usage": "direct"}, {"usage": "few_shot", "example_selection": "label_balanced"}, {"usage": "few_shot", "output": "label_explanation", "example_subjects": 1, "subject_split": "all"},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    for _ in range(2):  # the second run finds its answers
        assert cli.main(["run", "--config", str(tmp_path / "c.json"), "--cache", f"{out}/feature", "--out", f"{out}/runs", "--gpu-csv", str(gpu)]) == 0
    made = {p: json.loads((tmp_path / "out" / "runs" / f"{p}_metrics.json").read_text()) for p in ("hhar_feature_description_direct_label_only", "hhar_feature_description_few_shot_label_only", "hhar_feature_description_few_shot_label_explanation")}
    assert [m["n"] for m in made.values()] == [12, 6, 12]
    assert all(m["total_llm_calls"] == m["n"] and m["average_gpu_utilization_pct"] == 40.0 and m["estimated_total_cost_for_full_experiment"] > 0 for m in made.values())
    assert store.load_manifest(spark, f"{out}/feature").subjects == ["a", "b"]
