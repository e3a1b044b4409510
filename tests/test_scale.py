"""What replaces single tasks: scans by header, order statistics, islands and numbers by chunk, the leave-one-out pool by blocks."""

import gzip
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom import oracles, queries
from sensorloom.functions import cleaning as C
from sensorloom.functions.cleaning import stable_hash
from sensorloom.operators import metrics, order_stats, sampling, segments
from sensorloom.sources import discovery, headers, recordings
from tests import compare

STAGES = ["W", "N2", "?", "REM", "P"]


def night(order, names, n=120, unit=1.0, start=5.0):
    """A recording with columns in the order given: time, stage, hr, temp, bvp, each under its own name."""
    rows = [{"t": repr((start + i / 4) * unit), "stage": STAGES[i // 30], "hr": 60 + i % 7, "temp": 25 + i % 20, "bvp": i % 11} for i in range(n)]
    return "\n".join([",".join(names[k] for k in order), *(",".join(str(r[k]) for k in order) for r in rows)]) + "\n"


PLAIN = {"t": "TIMESTAMP", "stage": "Sleep_Stage", "hr": "HR", "temp": "TEMP", "bvp": "BVP"}
OTHER = {"t": "time", "stage": '"Sleep - _Stage"', "hr": "Heart  Rate", "temp": "Skin Temp", "bvp": "blood-volume"}


def test_headers_in_other_orders_and_names_give_equal_channels(spark, tmp_path):
    (tmp_path / "S001_whole_df.csv").write_text(night(["t", "hr", "temp", "bvp", "stage"], PLAIN))
    (tmp_path / "S002_whole_df.csv").write_text(night(["temp", "stage", "bvp", "t", "hr"], PLAIN))
    (tmp_path / "S003_whole_df.csv").write_text("﻿" + night(["stage", "temp", "hr", "bvp", "t"], OTHER, unit=1e9))
    with gzip.open(tmp_path / "S004_whole_df.csv.gz", "wt") as f:
        f.write(night(["hr", "t", "stage", "temp", "bvp"], OTHER, unit=1e3, start=0.0))
    (tmp_path / "S005_whole_df.csv").write_text(night(["t", "stage"], PLAIN))
    (tmp_path / ".hidden.csv").write_text("nothing")
    df = recordings.read_overnight(spark, [str(tmp_path)])
    shown = lambda s, *c: [tuple(r) for r in df.filter(F.col("subject") == s).orderBy("t").select(F.round("t", 6), "label", *c).collect()]
    want = shown("S001", "hr", "temp", "bvp", "skin_temp")
    assert len(want) == 120 and want[0][:5] == (0.0, 0, 60.0, 25.0, 0.0) and want[0][5] == 31.0
    for s in ("S002", "S003", "S004"):
        assert shown(s, "hr", "temp", "bvp", "skin_temp") == want
    assert shown("S005", "hr") == [(t, y, None) for t, y, *_ in want]
    assert [y for _, y, *_ in want[::30]] == [0, 1, None, 1]


def test_a_file_without_stages_is_named(spark, tmp_path):
    (tmp_path / "S001.csv").write_text(night(["t", "stage"], PLAIN))
    (tmp_path / "S002.csv").write_text("TIMESTAMP,HR\n1,2\n")
    with pytest.raises(ValueError, match="no stage column.*S002"):
        recordings.read_overnight(spark, [str(tmp_path / "*.csv")])
    with pytest.raises(FileNotFoundError):
        recordings.read_overnight(spark, [str(tmp_path / "none*")])


def test_rows_without_times_are_numbered_over_blocks(spark, tmp_path):
    n = 4000
    (tmp_path / "S007_a.csv").write_text("stage,hr\n" + "".join(f"W,{i}\n" for i in range(n)))
    (tmp_path / "S008_a.csv").write_text("hr,stage\n" + "".join(f"{i},R\n" for i in range(10)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = recordings.read_overnight(spark, [str(tmp_path)], 4.0)
        scan = headers.by_header(spark, headers.files_of(spark, [str(tmp_path / "S007*")]), recordings.OVERNIGHT)[0][1]
        assert scan.rdd.getNumPartitions() > 4
        assert df.filter("t <> hr / 4").count() == 0 and df.count() == n + 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_last_recording_of_a_subject_and_folders_of_parts(spark, tmp_path):
    (tmp_path / "S001_a.csv").write_text(night(["t", "stage"], PLAIN, 40))
    (tmp_path / "s001_b.csv").write_text(night(["t", "stage"], PLAIN, 20))
    (tmp_path / "other.x.csv").write_text(night(["t", "stage"], PLAIN, 10))
    folder = tmp_path / "S002_whole_df.csv"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-0000{k}.csv").write_text(night(["t", "stage"], PLAIN, 8, start=5.0 + 2 * k))
    (folder / "_SUCCESS").write_text("")
    files = headers.files_of(spark, [str(tmp_path)])
    assert {s: len(f) for s, f in recordings.latest(spark, files).items()} == {"S001": 1, "S002": 2, "other.x": 1}
    got = {r["subject"]: r["count"] for r in recordings.read_overnight(spark, [str(tmp_path)]).groupBy("subject").count().collect()}
    assert got == {"S001": 20, "S002": 16, "other.x": 10}
    assert list(discovery.select_files(spark, files, ["S002", "S9", "S001"])) == ["S002", "S001"]


def test_unlabelled_rows_keep_their_signals(spark, tmp_path):
    (tmp_path / "S001.csv").write_text("timestamp,stage,hr\n" + "".join(f"{i / 4},{'?' if i < 30 or i >= 80 else 'W'},{i}\n" for i in range(121)))
    w = recordings.overnight_windows(recordings.read_overnight(spark, [str(tmp_path)], 4.0), 4.0, 10.0).orderBy("window_id").collect()
    assert [(r.window_id, r.label, len(r.hr)) for r in w] == [(0, 0, 40), (1, 0, 40)]


@pytest.mark.parametrize("name,want", [("A - _b", "a_b"), ("a__b", "a_b"), (" a _ b ", "a_b"), ("_X.1", "x_1"), ("ACC-X (g)", "acc_x_g"), ("é", ""), ("Sleep_Stage", "sleep_stage")])
def test_normal_names(name, want):
    assert C.normal_name(name) == want


def test_detection_prefers_the_earlier_pattern():
    assert C.detect_column(["label", "Sleep__Stage", "stage"], recordings.OVERNIGHT["stage"]) == "Sleep__Stage"
    assert C.detect_column(["temperature_2", "TEMP"], recordings.OVERNIGHT["temp"]) == "TEMP"
    assert C.detect_column(["x", "Acc X"], recordings.OVERNIGHT["acc_x"]) == "Acc X" and C.detect_column(["tempo"], recordings.OVERNIGHT["temp"]) is None


@pytest.mark.parametrize("steps,want", [([1.0] * 5, 1.0), ([1.5] * 5, 1e3), ([0.5, 0.5, 3.0, 3.0], 1e3), ([0.5, 0.5, 1.0, 1.2], 1.0), ([1.0, 1.0, 2e6], 1.0), ([1e6, 1e6 + 2], 1e9), ([], 1.0), ([0.0, 0.0], 1.0)])
def test_units_are_those_of_the_median_step(spark, steps, want):
    times = [0.0]
    for s in steps:
        times.append(times[-1] + s)
    rows = [(t, "s") for t in times] + [(None, "s"), (float("nan"), "s")]
    df = spark.createDataFrame(rows, "t double, g string").repartition(3)
    assert C.seconds_divisor(df, "t") == want
    assert [tuple(r) for r in C.time_units(df, "t", ["g"]).collect()] == [("s", want, 0.0)]


def test_units_by_group(spark):
    rng = random.Random(2)
    rows = [(g, 100.0 + i * step + rng.random() * step / 3) for g, step in (("a", 0.02), ("b", 20.0), (None, 2e7), ("c", 0.5)) for i in range(400)] + [("d", None)]
    got = {r.g: r.divisor for r in C.time_units(spark.createDataFrame(rows, "g string, t double").repartition(7), "t", ["g"]).collect()}
    assert got == {"a": 1.0, "b": 1e3, None: 1e9, "c": 1.0}


def test_percentiles_equal_sparks(spark):
    rng = random.Random(1)
    make = {None: lambda: rng.gauss(0, 1), "few": lambda: float(rng.randint(0, 3)), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300), "hot": lambda: 0.0 if rng.random() < 0.6 else rng.random(), "one": lambda: 7.5}
    rows = [(g, f()) for g, f in make.items() for _ in range(2000)] + [("none", None), ("nan", float("nan")), ("single", 2.0), ("single", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    q = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 0.333, "f": 1.0}
    got = {r.g: tuple(r)[1:] for r in order_stats.percentiles(df, ["g"], "v", q, cells=16, few=20).collect()}
    want = {r.g: tuple(r)[1:] for r in df.filter("not isnan(v)").groupBy("g").agg(*(F.percentile("v", F.lit(x)) for x in q.values())).collect()}
    assert got == want | {"nan": (None,) * 6}
    assert tuple(order_stats.percentiles(df.filter("g = 'few'"), [], "v", q, cells=16, few=20).first()) == want["few"]
    assert order_stats.percentiles(df.limit(0), ["g"], "v", q).count() == 0


def test_cells_grow_with_values(spark):
    rng = random.Random(3)
    values = sorted([rng.uniform(-1e3, 1e3) for _ in range(300)] + [10.0 ** k for k in range(-20, 20)] + [0.0, -1e-9])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for spread in (False, True):
        cells = [r[0] for r in df.orderBy("v").select(order_stats._cell(F.col("v"), F.lit(values[0]), F.lit(values[-1]), spread, 50)).collect()]
        assert cells == sorted(cells) and cells[0] == 0 and cells[-1] == 49


def test_latency_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in metrics.latency(df, ["k"], "v").collect()}
    assert got[None][:3] == (2, 2.0, 2.0) and got["a"] == (1, 5.0, 5.0, 5.0, 5.0) and got["b"] == (1, None, None, None, None)


def islands(rows):
    out, by = [], {}
    for s, i, y in rows:
        by.setdefault(s, []).append((i, y))
    for s, x in by.items():
        x.sort(key=lambda r: r[0])
        at = 0
        while at < len(x):
            end = at
            while end < len(x) and x[end][1] == x[at][1]:
                end += 1
            if x[at][1] is not None:
                out.append((s, x[at][1], x[at][0], x[end - 1][0] + 1, end - at))
            at = end
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,chunk", [(1, 8), (2, 8), (3, 3), (4, 1), (5, 1 << 16)])
def test_islands_over_chunks(spark, seed, chunk):
    """Runs shorter and longer than chunks, chunks without rows, null labels and a null group."""
    rng, rows = random.Random(seed), []
    for s in ("p", None, "q"):
        i = 0
        for _ in range(rng.randint(1, 12)):
            y = rng.choice([None, "x", "y"])
            for _ in range(rng.choice([1, 2, 3, 50])):
                rows.append((s, i, y))
                i += rng.choice([1, 1, 1, 25 if seed % 2 else 1])
    df = spark.createDataFrame(rows, "s string, i long, y string").repartition(3)
    assert sorted(map(tuple, segments.label_islands(df, ["s"], "i", "y", chunk).collect()), key=str) == islands(rows)


def test_one_recording_is_many_tasks(spark):
    plan = segments.label_islands(spark.range(1000).selectExpr("'s' s", "id i", "id % 3 y"), ["s"], "i", "y", 10)
    assert plan.count() == 1000
    df = spark.range(1000).selectExpr("'s' s", "cast(id * 7 % 1000 as double) / 2 t", "id")
    got = segments.numbered(df, ["s"], "t", "id", "n", 3.0)
    assert got.filter("n <> t * 2").count() == 0 and got.count() == 1000


@pytest.mark.parametrize("block", [1024, 7, 2])
def test_leave_one_out_by_blocks(spark, block):
    subjects = spark.createDataFrame([(f"S{i}",) for i in range(60)] + [(None,)], "subject string")
    pool = subjects.limit(50)
    pairs = subjects.select(F.col("subject").alias("eval_subject")).join(pool, F.col("eval_subject") != F.col("subject"))
    w = Window.partitionBy("eval_subject").orderBy(stable_hash(42, "few-shot-subject", F.col("eval_subject"), F.col("subject")), "subject")
    want = pairs.withColumn("subject_rank", F.row_number().over(w)).filter("subject_rank <= 3")
    got = sampling.other_subjects(subjects, pool, "subject", 3, 42, block)
    assert got.columns == ["eval_subject", "subject", "subject_rank"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sampling.other_subjects(subjects, pool.limit(0), "subject", 3, 42, block).count() == 0


def test_features_of_windows_without_spread_equal_their_sql(spark, sf, tmp_path):
    """Equal values, equal sines, values so small that their moments vanish, missing values."""
    values = {1: [3.5], 2: [1.57079632, 1.57079633], 3: [1e-70, 3e-70, 2e-70], 4: [1.0, 2.0, 4.0], 5: [None], 6: [0.0, 1e-200, 1.0], 7: [None, 0.1]}
    rows = [(k * 100 + i, k, "click", v[i % len(v)]) for k, v in values.items() for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (event_id % 100) * 9000)")
    events.withColumn("ts", at).coalesce(1).write.parquet(str(tmp_path / "written"))
    for t in compare.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / "written").glob("*.parquet")) if t == "events" else f"{sf}/{t}.parquet")
    compare.assert_same(spark, str(tmp_path), queries.q_window_rf_features, oracles.ORACLES["q_window_rf_features"])
    got = queries.q_window_rf_features(spark, str(tmp_path)).groupBy("subject").agg(F.max("skew").alias("skew"), F.max("corr").alias("corr")).collect()
    got = {r.subject: r for r in got}
    assert set(got) == set(values) and (got[1].skew, got[1].corr) == (0.0, 0.0) and got[2].corr != got[2].corr and got[5].corr is None
