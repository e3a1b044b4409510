"""Builds and runs that stop, and go on: shards with a journal, answers with keys."""

import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from sensorloom import cli
from sensorloom.plans import experiment, materialise, scorer
from sensorloom.sources import store
from tests.test_materialise import motion_files


def made_rows(spark, subjects, fail=()):
    bad = [s for s in subjects if s in fail]
    if bad:
        raise RuntimeError(f"lost {bad[0]}")
    rows = [(s, k % 2, f"{s}_{k}", float(k)) for s in subjects for k in range(0 if s == "empty" else 6)]
    return spark.createDataFrame(rows, "subject string, label int, sample_id string, x double")


def test_a_build_that_stopped_goes_on(spark, tmp_path):
    root, names = str(tmp_path / "c"), ["a", "b", "c/d", "e", "empty"]
    asked = []

    def make(fail=()):
        return lambda part: (asked.append(list(part)), made_rows(spark, part, fail))[1]

    new = lambda: store.Manifest("D", loader_kwargs={"w": 2})
    with pytest.raises(RuntimeError, match="lost c/d"):
        store.build(spark, root, new(), names, make({"c/d"}), group=2)
    assert asked == [["a", "b"], ["c/d", "e"]] and not os.path.exists(f"{root}/manifest")
    with pytest.raises(Exception):
        materialise.union(spark, [root])
    first = {r.subject: r.digest for r in store.journal(spark, root).collect()}
    assert set(first) == {"a", "b"}
    asked.clear()
    got = store.build(spark, root, new(), names, make(), group=2)
    assert asked == [["c/d", "e"], ["empty"]]
    assert (got.sample_count, got.label_distribution, got.subjects) == (24, {"0": 12, "1": 12}, ["a", "b", "c/d", "e"])
    whole = store.build(spark, str(tmp_path / "w"), new(), names, make(), group=10)
    assert [(s["subject"], s["digest"], s["samples"]) for s in got.shards] == [(s["subject"], s["digest"], s["samples"]) for s in whole.shards]
    assert store.load(spark, root).count() == 24 and store.load_manifest(spark, root).shards[0]["labels"] == {"0": 3, "1": 3}
    asked.clear()
    assert store.build(spark, root, new(), names, make()).sample_count == 24 and asked == []


def test_other_settings_and_overwrite_build_again(spark, tmp_path):
    root, asked = str(tmp_path / "c"), []
    make = lambda part: (asked.append(list(part)), made_rows(spark, part))[1]
    store.build(spark, root, store.Manifest("D", loader_kwargs={"w": 2}), ["a", "b"], make)
    store.build(spark, root, store.Manifest("D", loader_kwargs={"w": 3}), ["a", "b"], make)
    store.build(spark, root, store.Manifest("D", loader_kwargs={"w": 3}), ["b", "c"], make)
    store.build(spark, root, store.Manifest("D", loader_kwargs={"w": 3}), ["b"], make, overwrite=True)
    assert asked == [["a", "b"], ["a", "b"], ["c"], ["b"]] and store.load(spark, root).count() == 18


def test_data_without_an_entry_are_replaced(spark, tmp_path):
    """A job that died after its data and before its entry."""
    root = str(tmp_path / "c")
    made_rows(spark, ["a", "b"]).write.partitionBy("subject").parquet(f"{root}/data")
    got = store.build(spark, root, store.Manifest("D"), ["a", "b"], lambda part: made_rows(spark, part))
    assert got.sample_count == 12 and store.load(spark, root).count() == 12


def test_digests_tell_contents_not_order(spark):
    rows = made_rows(spark, ["a", "b"])
    digest = lambda df: {r.subject: r.digest for r in store.shard_digests(df).collect()}
    assert digest(rows) == digest(rows.repartition(5).orderBy(F.desc("sample_id")))
    other = digest(rows.withColumn("x", F.when(F.col("sample_id") == "a_1", 9.0).otherwise(F.col("x"))))
    assert other["a"] != digest(rows)["a"] and other["b"] == digest(rows)["b"]
    assert digest(rows.unionByName(rows))["a"] != digest(rows)["a"]


def test_motion_windows_by_shard_equal_those_at_once(spark, tmp_path):
    motion_files(tmp_path / "in")
    root = str(tmp_path / "in")
    assert materialise.subjects_of(spark, "HHAR", root) == ["a", "b"]
    one = materialise.from_raw(spark, "HHAR", root, str(tmp_path / "one"))["windows"]
    assert cli.main(["windows", "--dataset", "HHAR", "--root", root, "--out", str(tmp_path / "two"), "--shard-by-subject", "--input", "raw_data"]) == 0
    two = store.load_manifest(spark, str(tmp_path / "two" / "windows"))
    assert (one.sample_count, one.label_distribution, one.subjects) == (two.sample_count, two.label_distribution, two.subjects)
    a, b = (store.load(spark, str(tmp_path / d / "windows")) for d in ("one", "two"))
    assert {r.subject: r.digest for r in store.shard_digests(a).collect()} == {s["subject"]: s["digest"] for s in two.shards} and b.count() == two.sample_count


@dataclasses.dataclass(frozen=True)
class Counted:
    """Notes every call in a file; fails for prompts that hold a word while a flag is there."""

    log: str
    labels: tuple = (0, 1)
    timeout: float = 1.0

    def __call__(self, prompt, temperature=None):
        with open(self.log, "a") as f:
            f.write(json.dumps([prompt, temperature]) + "\n")
        error = "http_500" if "bad" in prompt and os.path.exists(self.log + ".broken") else None
        return scorer.usage_row("m", prompt, None if error else '{"predicted_state": 1}', error, {"total_tokens": 3}, 0.5)

    def asked(self):
        return [json.loads(x) for x in open(self.log)] if os.path.exists(self.log) else []


def test_a_run_that_failed_asks_only_for_the_rest(spark, tmp_path):
    call, path = Counted(str(tmp_path / "log")), str(tmp_path / "answers")
    rows = [(f"s{i}", f"{'bad' if i % 10 == 3 else 'ok'} {i % 25}") for i in range(50)]
    df = spark.createDataFrame(rows, "sample_id string, prompt string").repartition(3)
    (tmp_path / "log.broken").write_text("")
    got = scorer.scored(df, call, path, calls=4, tasks=2)
    assert got.count() == 50 and got.filter("error is not null").count() == 5 and len(call.asked()) == 50
    with pytest.raises(RuntimeError, match="5 calls failed: s13"):
        scorer.raise_on_failures(got, "sample_id")
    (tmp_path / "log.broken").unlink()
    again = scorer.scored(df, call, path, calls=4, tasks=2)
    assert again.filter("response is null or error is not null").count() == 0 and again.count() == 50 and len(call.asked()) == 55
    assert again.columns == ["sample_id", "prompt", *(n.split()[0] for n in scorer.RESULT.split(", "))]
    scorer.scored(df, dataclasses.replace(call, timeout=9.0), path).count()
    assert len(call.asked()) == 55  # a time limit decides no answer
    scorer.scored(df, dataclasses.replace(call, labels=(0, 1, 2)), path).count()
    assert len(call.asked()) == 105


def test_answers_of_tasks_that_ended_survive_their_job(spark, tmp_path):
    """A job that fails leaves the answers of its other tasks; the next run does not repeat them."""
    call, path = Counted(str(tmp_path / "log")), str(tmp_path / "answers")
    df = spark.createDataFrame([(f"s{i}", f"p{i}") for i in range(40)], "sample_id string, prompt string")

    @dataclasses.dataclass(frozen=True)
    class Deadly(Counted):
        __qualname__ = "Counted"

        def __call__(self, prompt, temperature=None):
            if prompt == "p7":
                import time

                time.sleep(6)
                raise ValueError("worker lost")
            return Counted.__call__(self, prompt, temperature)

    with pytest.raises(Exception, match="worker lost"):
        scorer.scored(df, Deadly(call.log), path, threads=1, calls=4, tasks=10)
    before = [p for p, _ in call.asked()]
    kept = scorer.stored_answers(spark, path)
    n = kept.count()
    assert n > 20
    os.remove(call.log)
    assert scorer.scored(df, call, path, calls=4, tasks=10).filter("response is not null").count() == 40
    assert len(call.asked()) == 40 - n and len(before) >= n


def test_rows_that_share_a_key_and_null_prompts(spark, tmp_path):
    call = Counted(str(tmp_path / "log"))
    df = spark.createDataFrame([("a", "p", 0.1), ("a", "p", 0.1), ("a", "p", 0.2), ("b", "p", None)], "k string, prompt string, t double")
    got = scorer.scored(df, call, str(tmp_path / "x"), temperature="t", by=["k"])
    assert got.count() == 4 and sorted(map(str, call.asked())) == sorted(map(str, [["p", 0.1], ["p", 0.2], ["p", None]]))
    assert scorer.scored(df.limit(0), call, str(tmp_path / "y")).count() == 0 and len(call.asked()) == 3


@pytest.mark.parametrize("usage", ["direct", "multi_agent"])
def test_experiments_resume(spark, tmp_path, usage):
    call = Counted(str(tmp_path / "log"))
    views = F.create_map(F.lit("raw_data"), F.lit("r"))
    rows = spark.createDataFrame([(f"x{i}", "S1", i % 2, f"{'bad ' if i == 3 else ''}text {i}") for i in range(6)], "sample_id string, subject string, label int, input_text string").withColumn("input_views", views)
    e = experiment.Experiment("HHAR", "raw_data", usage)
    if usage == "direct":
        (tmp_path / "log.broken").write_text("")
        with pytest.raises(RuntimeError, match="x3"):
            experiment.run(e, rows, call, str(tmp_path / "run"))
        (tmp_path / "log.broken").unlink()
        assert len(call.asked()) == 6
    n = 7 if usage == "direct" else 30
    for _ in range(2):
        predictions, scores = experiment.run(e, rows, call, str(tmp_path / "run"))
        assert predictions.count() == 6 and scores.first()["accuracy"] == 0.5 and len(call.asked()) == n
