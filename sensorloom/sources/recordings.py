"""Readers of raw recordings: motion logs, overnight wearables, multi-rate stress recordings, question files, telemetry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import segments
from ..shared import persist, with_small
from . import headers

MOTION = "Creation_Time double, x double, y double, z double, User string, Model string, Device string, gt string"
REQUIRED = ("Creation_Time", "x", "y", "z", "User", "Model", "Device", "gt")
GROUP = ["user_id", "model", "device", "activity_label"]
#: Sampling rates of the stress recordings by channel.
RATES = {
    "chest_ecg": 700, "chest_eda": 700, "chest_emg": 700, "chest_resp": 700, "chest_temp": 700, "chest_acc": 700, "wrist_bvp": 64,
    "wrist_acc": 32, "wrist_eda": 4, "wrist_temp": 4,
}
STRESS_LONG = "subject string, channel string, axis string, fs int, idx bigint, value double"
# Header patterns of overnight recordings, in order of preference.
OVERNIGHT = {
    "timestamp": ["^timestamp$", "^time$"],
    "stage": ["sleep.*stage", "stage", "label", "annotation"],
    "bvp": ["^bvp$", "blood.*volume"],
    "ibi": ["^ibi$", "inter.*beat"],
    "eda": ["^eda$", "electrodermal", "gsr"],
    "temp": ["^temp$", "temperature", "skin.*temp"],
    "hr": ["^hr$", "heart.*rate"],
    "acc_x": ["acc.*x", "^x$"],
    "acc_y": ["acc.*y", "^y$"],
    "acc_z": ["acc.*z", "^z$"],
}
OVERNIGHT_CHANNELS = (
    "bvp", "bvp_filt", "ibi", "eda", "eda_lowpass", "temp", "skin_temp", "hr", "acc_x", "acc_y", "acc_z", "acc_x_filt", "acc_y_filt", "acc_z_filt", "actigraphy",
)


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


def read_motion(spark: SparkSession, path: str, max_rows: int | None = None, targets: dict[str, int] = C.STAIR_LABELS, divisor: float | None = None) -> DataFrame:
    """A motion log cleaned and labelled; ``max_rows`` keeps the first rows of the file, in file order."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    if max_rows is not None:
        raw = raw.withColumn("_row", F.monotonically_increasing_id()).orderBy("_row").limit(max_rows).drop("_row")
    df = raw.select(
        F.col("User").alias("user_id"), F.col("Model").alias("model"), F.col("Device").alias("device"),
        C.activity(F.col("gt")).alias("activity_label"), C.number(F.col("Creation_Time")).alias("time_raw"), *(C.number(F.col(c)).alias(c) for c in "xyz"),
    )
    df = df.filter(F.col("activity_label").isin(*targets)).dropna(subset=["user_id", "model", "device", "activity_label", "time_raw", "x", "y", "z"])
    df = df.withColumn("label", C.lookup(targets, F.col("activity_label")))
    return df.withColumn("time_sec", F.col("time_raw") / (divisor or C.seconds_divisor(df, "time_raw")))


def motion_windows(acc: DataFrame, gyro: DataFrame | None = None, rate: float = 10.0, window: int = 20, stride: int = 10, least: int = 10, gap: float = 5.0) -> DataFrame:
    """Windows of ``window`` tokens at ``rate``: ``x, y, z`` arrays, and ``gx, gy, gz`` where the second stream has rows.

    Windows are bins [k*stride, k*stride + window) of the downsampled segment, so no float start is accumulated.
    """
    tokens = _tokens(acc, rate, gap)
    last = F.max("bin").over(Window.partitionBy(*GROUP, "segment_id"))
    tokens = tokens.withColumn("_last", last)
    slots = segments.slots_of(F.col("bin").cast("double"), F.lit(0.0), F.col("_last").cast("double"), float(window), float(stride))
    spread = tokens.select("*", F.explode(slots).alias("window_id"))
    keys = [*GROUP, "segment_id", "window_id"]
    listed = F.array_sort(F.collect_list(F.struct("bin", "x", "y", "z")))
    out = spread.groupBy(*keys).agg(F.min_by("label", "bin").alias("label"), F.min("time_sec").alias("first_sec"), listed.alias("rows"), F.min("t0").alias("t0"))
    out = out.filter(F.size("rows") >= least).withColumns({c: _field("rows", c) for c in "xyz"}).drop("rows")
    out = out.withColumn("window_start", F.col("t0") + F.col("window_id") * (stride / rate)).withColumn("window_end", F.col("window_start") + window / rate).drop("t0", "first_sec")
    if gyro is None:
        return out
    other = _tokens(gyro, rate, gap)
    use = segments.matched_segments(tokens, other, GROUP, "segment_id")
    width = window / rate
    wide = out.join(use, [*GROUP, "segment_id"], "left")
    touched = F.sequence(F.floor(F.col("window_start") / width), F.floor(F.col("window_end") / width))
    spread = wide.select(*keys, "window_start", "window_end", "right_segment", F.explode(touched).alias("_b"))
    rows = other.select(*GROUP, F.col("segment_id").alias("_s"), F.col("time_sec").alias("_t"), *(F.col(c).alias(f"g{c}") for c in "xyz"), F.floor(F.col("time_sec") / width).alias("_b"))
    met = spread.join(rows, [*GROUP, "_b"]).filter("_t >= window_start and _t < window_end and (right_segment = -1 or right_segment = _s)")
    g = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", "gx", "gy", "gz"))).alias("g")).filter(F.size("g") >= least)
    g = g.withColumns({f"g{c}": _field("g", f"g{c}") for c in "xyz"}).drop("g")
    return out.join(g, keys, "left")


def _tokens(df: DataFrame, rate: float, gap: float) -> DataFrame:
    cut = segments.gap_segments(df, GROUP, "time_sec", gap)
    t0 = F.min("time_sec").over(Window.partitionBy(*GROUP, "segment_id"))
    rows = cut.withColumn("t0", t0).withColumn("bin", F.floor((F.col("time_sec") - F.col("t0")) * rate))
    out = rows.groupBy(*GROUP, "segment_id", "t0", "bin").agg(*(F.avg(c).alias(c) for c in "xyz"), F.min_by("label", "time_sec").alias("label"))
    return out.withColumn("time_sec", F.col("t0") + F.col("bin") / rate)


def subject_of(path: Column) -> Column:
    """``S`` and digits in a recording's name, upper case; else the name without extension.

    A recording is a file, or the folder that holds the parts Spark wrote of it.
    """
    name = F.regexp_extract(F.regexp_replace(path, r"/part-[^/]*$", ""), r"([^/]*)$", 1)
    found = F.upper(F.regexp_extract(name, r"(?i)S\d+", 0))
    return F.when(found != "", found).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def latest(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The files of each subject's recording, of several recordings the last by path."""
    rows = spark.createDataFrame([(f,) for f in files], "path string")
    rows = rows.select("path", subject_of(F.col("path")).alias("subject"), F.regexp_replace("path", r"/part-[^/]*$", "").alias("recording"))
    each = rows.groupBy("subject", "recording").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {r["subject"]: r["paths"] for r in each.groupBy("subject").agg(F.max_by("paths", "recording").alias("paths")).orderBy("subject").collect()}


def read_overnight(spark: SparkSession, paths: list[str], rate: float = 64.0) -> DataFrame:
    """Overnight recordings with canonical names: ``subject, t`` (seconds from the subject's first), ``label``, channels.

    Each file is read by its own header, so files may order and name their columns differently; a channel some
    lack is null there. One recording a subject, the last by path. Units of time are found per subject; files
    without times get the row's number over ``rate``. Rows without time are dropped, rows without a known stage
    have a null label and stay: their signals belong to the night. A file without a stage column is an error.
    """
    files = [f for found in latest(spark, headers.files_of(spark, paths)).values() for f in found]
    if not files:
        raise FileNotFoundError(f"no recordings among {paths}")
    parts = None
    for found, scan in headers.by_header(spark, files, OVERNIGHT, ("stage",)):
        if "timestamp" in found:
            scan = scan.withColumn("t", C.number(F.col("timestamp")))
        else:
            scan = headers.line_numbers(scan, "_row").withColumn("t", F.col("_row") / rate)
        rows = scan.select(
            subject_of(F.col("_path")).alias("subject"), "t", C.sleep_wake(F.col("stage")).alias("label"), F.lit("timestamp" in found).alias("_timed"),
            *(C.number(F.col(k)).alias(k) for k in OVERNIGHT if k in found and k not in ("timestamp", "stage")),
        )
        parts = rows if parts is None else parts.unionByName(rows, allowMissingColumns=True)
    out = parts.filter("t is not null")
    channels = [k for k in OVERNIGHT if k in out.columns]
    units = persist(C.time_units(out, "t", ["subject"]), "units")
    divisor = F.when(F.col("_timed"), F.col("divisor")).otherwise(F.lit(1.0))
    seconds = F.col("t") / divisor - F.col("first") / divisor
    out = with_small(out, units, "subject").select("subject", seconds.alias("t"), "label", *channels)
    if "temp" in channels:
        out = out.withColumn("skin_temp", C.clipped(F.col("temp"), 31.0, 40.0))
    if {"acc_x", "acc_y", "acc_z"} <= set(channels):
        out = out.withColumn("actigraphy", F.sqrt(sum((F.col(f"acc_{a}") ** 2 for a in "yz"), F.col("acc_x") ** 2)))
    return out


def filtered(df: DataFrame, rate: float = 64.0) -> DataFrame:
    """Overnight recordings with band-passed axes ``acc_*_filt``, pulse ``bvp_filt`` and low-passed ``eda_lowpass``.

    A filter without phase runs over a whole night both ways, so a night is one task: 8 hours at 64 Hz are 2 million
    rows. Rows are taken in order of time.
    """
    from ..ship import ensure

    ensure()
    axes = [f"acc_{a}" for a in "xyz" if f"acc_{a}" in df.columns]
    made = [*(f"{a}_filt" for a in axes), *(n for c, n in (("bvp", "bvp_filt"), ("eda", "eda_lowpass")) if c in df.columns)]
    if not made:
        return df

    def run(night):
        from ..functions import dsp

        night = night.sort_values("t", kind="stable")
        for a in axes:
            night[f"{a}_filt"] = dsp.butter_band(night[a].to_numpy(float), rate, 3.0, 11.0, 5)
        if "bvp" in night:
            night["bvp_filt"] = dsp.cheby2_band(night["bvp"].to_numpy(float), rate, 0.5, 20.0)
        if "eda" in night:
            night["eda_lowpass"] = dsp.butter_low(night["eda"].to_numpy(float), rate, 1.0)
        return night

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{n}` double" for n in made])
    return df.groupBy("subject").applyInPandas(run, schema)


def overnight_windows(df: DataFrame, rate: float = 64.0, seconds: float = 30.0, stride: float | None = None, share: float = 0.8) -> DataFrame:
    """Epochs with enough rows and a label: mode label, channel arrays in order of time, artifact flag inputs.

    Rows without a label count as rows and keep their signals.
    """
    wide = segments.anchored_windows(df, ["subject"], "t", seconds, stride or seconds, 1e-9)
    keys = ["subject", "window_id", "window_start", "window_end"]
    channels = [c for c in OVERNIGHT_CHANNELS if c in df.columns]
    listed = F.array_sort(F.collect_list(F.struct("t", *channels)))
    out = wide.groupBy(*keys).agg(listed.alias("rows"), F.mode("label", True).alias("label"))
    out = out.filter((F.size("rows") >= max(1, int(rate * seconds * share))) & F.col("label").isNotNull())
    out = out.withColumns({c: _field("rows", c) for c in channels}).drop("rows")
    none = F.array().cast("array<double>")
    x = lambda c: F.col(c) if c in channels else none
    return out.withColumn("artifact", F.coalesce(artifact(x("bvp"), x("actigraphy"), snr(x("bvp"), rate)), F.lit(False)))


def snr(x: Column, rate: float) -> Column:
    """Signal-to-noise ratio of each window in dB; NaN for less than 5 s. ``x`` is a column, not an expression."""
    from ..ship import ensure

    ensure()

    @F.pandas_udf("double")
    def run(windows):
        import numpy as np
        import pandas as pd

        from ..functions import dsp

        return pd.Series([dsp.snr_db(np.asarray([] if w is None else w, float), rate) for w in windows], dtype=float)

    return run(x)


def artifact(bvp: Column, movement: Column, snr_db: Column) -> Column:
    """Movement variance over 0.4125, a pulse sample beyond 500, or a known signal-to-noise ratio below 10 dB."""
    from ..functions.arrays import variance

    moved = F.coalesce(variance(movement) > 0.4125, F.lit(False))
    return moved | F.coalesce(F.exists(bvp, lambda v: F.abs(v) > 500), F.lit(False)) | F.coalesce((snr_db < 10) & ~F.isnan(snr_db), F.lit(False))


def read_stress(spark: SparkSession, root: str, subjects: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals in long form and labels of pickled recordings ``<root>/S2/S2.pkl``, of all subjects or those asked for.

    Only for trusted files: pickles run code.
    """
    from .discovery import stress_subjects

    def unpack(batches):
        import pickle

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                data = pickle.loads(bytes(content), encoding="latin1")
                subject = path.rstrip("/").split("/")[-2]
                parts = {f"{place}_{k.lower()}": v for place in ("chest", "wrist") for k, v in data["signal"][place].items()}
                for channel, values in parts.items():
                    if channel not in RATES:
                        continue
                    values = np.asarray(values, float).reshape(len(values), -1)
                    for j in range(values.shape[1]):
                        for at in range(0, len(values), 500_000):
                            v = values[at : at + 500_000, j]
                            yield pd.DataFrame({"subject": subject, "channel": channel, "axis": "xyz"[j] if values.shape[1] > 1 else None, "fs": RATES[channel], "idx": np.arange(at, at + len(v)), "value": v})
                label = np.asarray(data["label"], float)
                yield pd.DataFrame({"subject": subject, "channel": "label", "axis": None, "fs": 700, "idx": np.arange(len(label)), "value": label})

    found = stress_subjects(spark, root, subjects)
    if not found:
        raise FileNotFoundError(f"no stress recordings below {root}")
    files = spark.read.format("binaryFile").load([f"{root}/{s}/{s}.pkl" for s in found]).select("path", "content")
    long = files.mapInPandas(unpack, STRESS_LONG)
    labels = long.filter("channel = 'label'").select("subject", "idx", F.col("value").cast("int").alias("state"))
    return long.filter("channel <> 'label'"), labels.withColumn("label", C.stress(F.col("state")))


def stress_windows(signals: DataFrame, labels: DataFrame, seconds: float = 60.0, acc_seconds: float = 5.0, stride: float = 60.0) -> DataFrame:
    """Centred windows inside islands of one label; each channel is gathered at its own rate around one centre time."""
    marked = labels.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))
    islands = segments.label_islands(marked, ["subject"], "idx", "label")
    centres = segments.centred_windows(islands, int(seconds * 700 / 2), int(stride * 700)).select("subject", "label", "centre")
    parts = None
    for channel, fs in RATES.items():
        half = int((acc_seconds if channel.endswith("acc") else seconds) * fs / 2)
        c = F.floor(F.col("centre") / 700 * fs).cast("bigint")
        w = centres.select("subject", "label", "centre", F.greatest(c - half, F.lit(0)).alias("first"), (c + half).alias("last"))
        rows = signals.filter(F.col("channel") == channel)
        for axis in ("x", "y", "z") if channel.endswith("acc") else (None,):
            own = rows.filter(F.col("axis").eqNullSafe(F.lit(axis).cast("string")))
            got = segments.gathered(w, own, ["subject"], "idx", "value", max(1, 2 * half)).select("subject", "label", "centre", F.lit(channel).alias("channel"), F.lit(axis).cast("string").alias("axis"), "values")
            parts = got if parts is None else parts.unionByName(got)
    return parts


def read_questions(spark: SparkSession, path: str, label_keys: tuple[str, ...] = ("label", "true_label", "y")) -> DataFrame:
    """Question files ``{"dataset": [...]}`` or a bare list; the label must be explicit, never from an answer."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("dataset").alias("r")).select("r.*") if "dataset" in raw.columns and raw.schema["dataset"].dataType.typeName() == "array" else raw
    keys = [k for k in label_keys if k in rows.columns]
    if not keys:
        raise ValueError("no explicit label in the file")
    labelled = rows.withColumn("label", F.coalesce(*(C.coerced_label(F.col(k).cast("string")) for k in keys)))
    if labelled.filter("label is null").limit(1).count():
        raise ValueError("some samples have no explicit label")
    return labelled


def read_gpu(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry rows as numbers: utilisation, memory, power; columns are found by prefix."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    wanted = {"utilization_gpu": "utilization.gpu", "utilization_memory": "utilization.memory", "memory_used": "memory.used", "memory_total": "memory.total", "power_draw": "power.draw"}
    found = {k: next((c for c in raw.columns if c.strip().lower().startswith(p)), None) for k, p in wanted.items()}
    return raw.select(*(C.first_number(F.col(f"`{c}`")).alias(k) if c else F.lit(None).cast("double").alias(k) for k, c in found.items()))


def gpu_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("gpu_samples"), *(f(c).alias(f"{n}_{c}") for c in df.columns for n, f in (("avg", F.avg), ("max", F.max))))


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation entry with the best F1 of a trainer log."""
    logs = spark.read.option("multiLine", True).json(path).select(F.explode("log_history").alias("e")).select("e.*")
    score = F.coalesce(*(F.col(c) for c in ("eval_f1_macro", "eval_f1") if c in logs.columns), F.lit(-1.0))
    evals = [c for c in logs.columns if c.startswith("eval_")]
    return logs.filter(F.coalesce(*(F.col(c).isNotNull() for c in evals)) if evals else F.lit(False)).agg(F.max_by(F.struct(*logs.columns), score).alias("best")).select("best.*")


def natural(names: list[str]) -> list[str]:
    return sorted(names, key=lambda s: [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", str(s))])
