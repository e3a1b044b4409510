"""Question files: labels that must be explicit, containers of any depth, signals by index."""

import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.plans import materialise
from sensorloom.sources import questions


def saved(path, value):
    path.write_text("﻿" + json.dumps(value) if isinstance(value, dict) else json.dumps(value))
    return str(path)


def item(**k):
    return {"subject": "S2", "qa_pair": {"Q": "What is the class?", "A": "Stress"}, **k}


def signals_of(rows):
    return {r.place: {s.name: (s.x, s.y, s.z) for s in r.signals} for r in rows}


@pytest.mark.parametrize("fields,want", [
    ({"label": 1}, 1), ({"label": "0"}, 0), ({"label": " 1 "}, 1), ({"label": 1.9}, 1), ({"label": "1.9", "y": 0}, 0), ({"label": None, "target": 1}, 1), ({"majority_label": "Stress"}, 1),
    ({"label": "none", "class_label": "No-stress"}, 0), ({"y": -3}, -3), ({"majority_label": 0, "majority_label_original": 1}, 1), ({"label": [1]}, None), ({"answer": 1}, None), ({}, None),
])
def test_labels(spark, fields, want):
    row = spark.createDataFrame([(json.dumps(item(**fields)),)], "item string")
    assert row.select(questions.item_label(F.col("item"))).first()[0] == want


def test_items_keep_their_own_signals_and_places(spark, tmp_path):
    path = saved(tmp_path / "qa.json", {"dataset": [
        item(index=0, label=1, signals={"wrist_eda": [0.1, "bad", 0.2, None, "0.3"], "unknown": ["bad", None]}, start_index=5),
        item(index=1, label=0, data={"hr": 60}, subject="S3"),
        item(label=1, features={"signal": {"wrist": {"BVP": [1, 2]}}, "left": [9]}, signals="no container"),
    ]})
    got = questions.question_samples(spark, path).orderBy("place").collect()
    assert [(r.subject, r.label, r.data_index, r.question, r.start_index) for r in got] == [("S2", 1, 0, "What is the class?", 5), ("S3", 0, 1, "What is the class?", None), ("S2", 1, None, "What is the class?", None)]
    assert signals_of(got) == {0: {"wrist_eda": ([0.1, 0.2, 0.3], None, None)}, 1: {"hr": ([60.0], None, None)}, 2: {"wrist_bvp": ([1.0, 2.0], None, None)}}
    assert questions.question_samples(spark, path, subjects=["S3"]).count() == 1 and questions.question_samples(spark, path, wanted=[1]).count() == 2


def test_a_label_never_comes_from_an_answer(spark, tmp_path):
    path = saved(tmp_path / "qa.json", {"dataset": [item(label=0), item(index=1, signals={"wrist_eda": [1]}), item(label=0, subject="S9")]})
    with pytest.raises(ValueError, match="item 1 of .*no explicit label"):
        questions.question_samples(spark, path)
    assert questions.question_samples(spark, path, subjects=["S9"]).count() == 1


def test_containers_of_any_depth_in_order(spark):
    deep = {"z": [1], "data": {"b": [2], "signals": {"signal": {"Chest": {"ECG-1": [3], "ecg 1": [4]}, "features": {"a": [5]}}, "gone": [0]}, "z": [6]}, "wrist": [7], "chest": {"signals": {"no": [1]}}}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "{}"), (3, json.dumps({"x": None, "signal": [8]}))], "id int, value string")
    got = {r.id: [(s.name, s.value) for s in r.signals] for r in questions.flattened(df).collect()}
    assert got == {1: [("z", "[6]"), ("b", "[2]"), ("chest_ecg_1", "[4]"), ("a", "[5]"), ("wrist", "[7]"), ("chest_signals", '{"no":[1]}')], 3: [("x", None), ("signal", "[8]")]}


@pytest.mark.parametrize("name,value,want", [
    ("ACC", [[1, 2, 3], [4, 5, 6]], ([1.0, 4.0], [2.0, 5.0], [3.0, 6.0])), ("wrist-acc", [[1, 2], [3, 4], [5, "x"]], ([1.0, 2.0], [3.0, 4.0], [5.0])),
    ("acc", [[1], [2], [3], [4]], ([1.0, 2.0, 3.0, 4.0], None, None)), ("eda", [[1, 2, 3], [4, 5, 6]], ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None, None)),
    ("acc", [1, 2, 3], ([1.0, 2.0, 3.0], None, None)), ("x", [[[1], [2]], [[3], ["q"]]], ([1.0, 2.0, 3.0], None, None)), ("x", 5, ([5.0], None, None)), ("x", "nan", ([], None, None)),
    ("x", {"a": [1]}, ([], None, None)), ("x", None, ([], None, None)), ("gyro", [[1, 2, 3]] * 3, ([1.0] * 3, [2.0] * 3, [3.0] * 3)),
])
def test_shapes(spark, name, value, want):
    text = json.loads(json.dumps(json.dumps(value))) if not isinstance(value, str) else value
    df = spark.createDataFrame([(name, None if value is None else text)], "n string, v string")
    assert tuple(df.select(questions.signal(F.col("n"), F.col("v")).alias("s")).first().s)[1:] == want


ITEMS = [item(label=0, index=0), item(label=1, index=-1), item(label=1, data_index="1"), item(label=0, index=9), item(label=1), item(label=0, index=None, data_index=1), item(label=0, index=1, signals={"own": [1]})]


@pytest.mark.parametrize("kind", ["json", "pkl"])
def test_signals_by_place_of_a_list(spark, tmp_path, kind):
    data = [{"data": {"hr": [1]}}, {"eda": [2], "signals": [0]}, {"signal": {"wrist": {"ACC": np.arange(12.0).reshape(4, 3).tolist()}}}]
    path = saved(tmp_path / "d.json", data)
    if kind == "pkl":
        path = str(tmp_path / "d.pkl")
        with open(path, "wb") as f:
            pickle.dump([data[0], data[1], {"signal": {"wrist": {"ACC": np.arange(12.0).reshape(4, 3)}}}], f)
    got = signals_of(questions.question_samples(spark, saved(tmp_path / "qa.json", ITEMS), path).collect())
    assert got[0] == {"hr": ([1.0], None, None)} and got[1]["wrist_acc"][1] == [1.0, 4.0, 7.0, 10.0] and got[2]["eda"][0] == [2.0]
    assert got[3] == got[4] == got[5] == {} and got[6] == {"own": ([1.0], None, None)}


@pytest.mark.parametrize("kind", ["json", "pkl"])
def test_signals_by_key_of_an_object(spark, tmp_path, kind):
    data = {"0": {"hr": [1]}, "1": {"eda": [2]}, "whole": [3]}
    path = saved(tmp_path / "d.json", data)
    if kind == "pkl":
        path = str(tmp_path / "d.pkl")
        with open(path, "wb") as f:
            pickle.dump({0: {"hr": [1]}, "1": {"eda": np.array([2])}, "whole": [3]}, f)
    got = signals_of(questions.question_samples(spark, saved(tmp_path / "qa.json", ITEMS), path).collect())
    assert got[0] == {"hr": ([1.0], None, None)} and got[2] == {"eda": ([2.0], None, None)} and got[1] == got[3] == {}
    assert got[4]["whole"] == ([3.0], None, None)  # no index: the object itself


def test_lines_and_texts(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text("\n".join(json.dumps(item(label=i % 2, index=i)) for i in range(4)) + "\n")
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"index": i, "data": {"chest": {"EDA": [i, 1, 2]}}}) for i in range(4)))
    rows = questions.question_samples(spark, str(tmp_path / "qa.jsonl"), str(tmp_path / "d.jsonl"))
    assert {r.data_index: r.signals[0].x for r in rows.collect()} == {i: [float(i), 1.0, 2.0] for i in range(4)}
    made = rows.withColumns({"dataset": F.lit("WESAD"), "sample_id": F.concat(F.lit("q"), F.col("data_index"))})
    assert all("<CHEST_EDA_CHANNEL>" in r.input_text for r in materialise.texts(made, "WESAD", "embedding").collect())


def test_blocks_of_nested_containers(spark, tmp_path):
    """Channels of both places, axes in either orientation, tags with and without a place."""
    t = np.linspace(0.0, 1.0, 12)
    signals = {
        "chest": {"ECG": t.tolist(), "EDA": t.tolist(), "ACC": [t.tolist(), t[::-1].tolist(), [1.0] * 12]},
        "wrist": {"BVP": np.sin(6 * t).tolist(), "ACC": np.column_stack([t, t[::-1], np.ones(12)]).tolist()}, "heart_rate": [60, 61], "unknown": ["bad"],
    }
    rows = questions.question_samples(spark, saved(tmp_path / "qa.json", {"dataset": [item(label=1, signals=signals), item(label=1, signals={"unknown": ["bad"]})]}))
    made = rows.withColumns({"dataset": F.lit("WESAD"), "sample_id": F.concat(F.lit("q"), F.col("place"))})
    text, none = (r.input_text for r in materialise.texts(made, "WESAD", "embedding").orderBy("sample_id").collect())
    tags = [x[1:-1] for x in text.splitlines() if x.startswith("<") and not x.startswith("</")]
    assert tags == [f"{c}_CHANNEL" for c in ("CHEST_ECG", "CHEST_EDA", "CHEST_ACC_X", "CHEST_ACC_Y", "CHEST_ACC_Z", "WRIST_BVP", "WRIST_ACC_X", "WRIST_ACC_Y", "WRIST_ACC_Z", "HR")]
    assert "- Sudden changes or peaks: insufficient evidence" in text and "No valid numeric sensor channel" in none
    assert not any(w in text.lower() for w in ("baseline", "stress", "amusement"))


def test_empty_and_broken_files(spark, tmp_path):
    assert questions.question_samples(spark, saved(tmp_path / "a.json", {"dataset": []})).count() == 0
    assert questions.question_samples(spark, saved(tmp_path / "b.json", {"other": 1})).count() == 0
    (tmp_path / "c.json").write_text('{"dataset": [{"label"')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        questions.question_samples(spark, str(tmp_path / "c.json")).count()
