"""Windows described in words: statistics of all channels, sleep cues, physiological values of stress recordings.

A window's channels come as ``signals array<struct<name,x,y,z>>`` (y and z null for one axis). Statistics, cues and
sections are Column expressions; Python prints the numbers, as they must round as Python's do, and computes
spectra, beats and filtered parts of the stress recordings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dsp
from ..functions.text import UNAVAILABLE
from ..ship import ensure
from .channels import channel_key
from .render import is_motion, is_sleep

SIGNALS = "array<struct<name:string,x:array<double>,y:array<double>,z:array<double>>>"
# Titles, and sections with the first words of the channels they hold.
TITLE = "Input feature description:"
TITLES = {"HHAR": "Input feature description for HHAR:", "DREAMT": "Input feature description for DREAMT:", "WESAD": "Input feature description for WESAD paper-style features:"}
SECTIONS = {
    "HHAR": {"Accelerometer": ["acc", "accelerometer", "x", "y", "z"], "Gyroscope": ["gyro", "gyroscope"]},
    "DREAMT": {
        "Electrodermal activity": ["eda", "gsr"], "Pulse and heart-rate signals": ["bvp", "ppg", "pulse", "hr", "heart_rate", "ibi"],
        "Temperature": ["temp", "temperature", "skin_temp"], "Activity and movement": ["acc", "actigraphy", "activity", "motion"],
    },
}
SLEEP_SECTION = "DREAMT sleep/wake wearable features"
STRESS_SECTIONS = {
    "Chest ACC": ("chest_acc_",), "Chest ECG/HRV": ("chest_hr",), "Chest EDA/SCR": ("chest_eda_", "chest_scl_", "chest_scr_"),
    "Chest EMG": ("chest_emg_",), "Chest RESP": ("chest_resp_",), "Chest TEMP": ("chest_temp_",), "Wrist ACC": ("wrist_acc_",),
    "Wrist BVP/HRV": ("wrist_hr",), "Wrist EDA/SCR": ("wrist_eda_", "wrist_scl_", "wrist_scr_"), "Wrist TEMP": ("wrist_temp_",),
}
PER_LINE = 4


def _axes(signal: Column) -> Column:
    """The axes of a channel, one or three, of finite values."""
    return F.transform(F.filter(F.array(signal["x"], signal["y"], signal["z"]), lambda v: v.isNotNull()), A.clean)


def _root(axes: Column) -> Column:
    """The magnitude of three axes, over their common length."""
    n = F.array_min(F.transform(axes, F.size))
    return A.magnitude(*(F.slice(F.get(axes, F.lit(i)), F.lit(1), n) for i in range(3)))


def _by_name(signals: Column) -> Column:
    placed = F.transform(signals, lambda s, i: F.struct(s["name"].alias("n"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(placed), lambda p: p["s"])


def described_signals(signals: Column) -> Column:
    """``array<struct<name, stats>>`` by name: each one-axis channel, or the axes and the magnitude of a three-axis one."""

    def parts(s: Column) -> Column:
        def of(axes: Column) -> Column:
            one = lambda suffix, x: F.struct(F.concat(s["name"], F.lit(suffix)).alias("name"), x.alias("x"))
            wide = F.array(*(one(f"_{k}", F.get(axes, F.lit(i))) for i, k in enumerate("xyz")), one("_magnitude", _root(axes)))
            return F.when(F.size(axes) == 3, wide).otherwise(F.array(one("", F.coalesce(F.get(axes, F.lit(0)), F.array().cast("array<double>")))))

        return A.let(_axes(s), of)

    flat = F.flatten(F.transform(_by_name(signals), parts))
    return F.transform(flat, lambda p: F.struct(p["name"].alias("name"), A.described(p["x"]).alias("stats")))


def printed(features: Column) -> Column:
    """The line of each feature as ``array<struct<name, line>>``, its numbers with three places. ``features`` is a column."""

    def line(f) -> dict:
        stats = f["stats"]
        shown = (f"{k}={UNAVAILABLE if stats[k] is None or stats[k] != stats[k] else format(stats[k], '.3f')}" for k in ("mean", "std", "min", "max", "p25", "p75"))
        return {"name": f["name"], "line": f"- {f['name']}: {', '.join(shown)}, trend={stats['trend']}"}

    @F.pandas_udf("array<struct<name:string,line:string>>")
    def show(rows: pd.Series) -> pd.Series:
        return pd.Series([[line(f) for f in (row if row is not None else [])] for row in rows])

    return show(features)


def printed_cues(cues: Column) -> Column:
    """A line for each cue."""

    @F.pandas_udf("array<string>")
    def show(rows: pd.Series) -> pd.Series:
        return pd.Series([[f"- sleep_{c['name']}: {c['value']:.3f}" for c in (row if row is not None else [])] for row in rows])

    return show(cues)


def block_text(lines: Column, title: str, sections: dict[str, list[str]] | None = None) -> Column:
    """Lines (``array<struct<name, line>>``) under the first section that claims their channel, then all others; without
    sections one list."""
    text = F.lit(title)
    if sections:

        def own(name: Column) -> Column:
            hits = [F.when((name == p.lower()) | name.startswith(f"{p.lower()}_"), k) for k, prefixes in sections.items() for p in prefixes]
            return F.coalesce(*hits, F.lit("Other signals"))

        marked = F.transform(lines, lambda s: F.struct(own(F.lower(s["name"])).alias("k"), s["line"].alias("line")))

        def listed(rows: Column) -> Column:
            def section(k: str) -> Column:
                own = F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["line"])
                return A.let(own, lambda p: F.when(F.size(p) > 0, F.concat(F.lit(f"\n{k}:\n"), F.array_join(p, "\n"))))

            return F.concat_ws("\n", text, *map(section, [*sections, "Other signals"]))

        shown = A.let(marked, listed)
    else:
        shown = F.concat_ws("\n", text, F.transform(lines, lambda s: s["line"]))
    return F.when(F.size(lines) > 0, shown).otherwise(f"{title}\n- no numeric signals available")


def keyed(signals: Column) -> Column:
    """``array<struct<key, x>>``: the values of each channel; axes of one length interleaved, others after each other."""

    def flat(axes: Column) -> Column:
        n = F.size(F.get(axes, F.lit(0)))
        level = (F.size(axes) > 1) & (n > 0) & F.forall(axes, lambda a: F.size(a) == n)
        mixed = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(axes, lambda a: F.get(a, i))))
        return F.when(level, mixed).otherwise(F.flatten(axes))

    return F.transform(signals, lambda s: F.struct(channel_key(s["name"]).alias("key"), A.let(_axes(s), flat).alias("x")))


def first_signal(found: Column, names: tuple[str, ...]) -> Column:
    """The values of the first channel of :func:`keyed` of one of these names, or else whose name holds one; empty ones do
    not count. Null if there is none."""
    named = lambda n: F.filter(found, lambda s: s["key"] == n)
    parts = F.filter(found, lambda s: F.exists(F.array(*map(F.lit, names)), lambda n: s["key"].contains(n)))
    return F.get(F.filter(F.concat(*map(named, names), parts), lambda s: F.size(s["x"]) > 0), F.lit(0))["x"]


#: Sleep cues: prefix, names of their channel, slope or not.
_CUES = (
    ("heart_rate", ("heart_rate", "hr"), True), ("ibi", ("ibi",), False), ("bvp", ("bvp", "ppg", "pulse"), True), ("eda", ("eda", "gsr"), True),
    ("skin_temperature", ("skin_temp", "temperature", "temp"), True),
)


def _moved(found: Column) -> Column:
    axes = F.array(*(first_signal(found, tuple(f"{p}_{k}" for p in ("acc", "accelerometer", "actigraphy"))) for k in "xyz"))
    return A.let(axes, lambda a: F.when(F.forall(a, lambda v: v.isNotNull()), _root(a)).otherwise(first_signal(found, ("actigraphy", "activity", "motion"))))


def sleep_features(signals: Column) -> Column:
    """Sleep cues as ``array<struct<name, value>>`` by name; those of missing channels are left out."""
    cue = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))

    def series(prefix: str, x: Column, slope: bool) -> list[Column]:
        out = [cue(f"{prefix}_mean", A.mean(x)), cue(f"{prefix}_std", A.std(x)), cue(f"{prefix}_range", F.array_max(x) - F.array_min(x))]
        return out + [cue(f"{prefix}_slope", A.slope(x))] * slope

    def moves(x: Column) -> Column:
        far = A.movement(x)
        return F.array(*series("acc_magnitude", x, False), cue("movement_count", far["movements"]), cue("stillness_ratio", far["stillness"]))

    def channel(prefix: str, slope: bool, x: Column) -> Column:
        out = series(prefix, x, slope)
        out += [cue("ibi_rmssd", A.rmssd(x))] * (prefix == "ibi") + [cue(f"{prefix}_peak_count", A.peak_count(x))] * (prefix in ("bvp", "eda"))
        return F.array(*out)

    def all_cues(found: Column) -> Column:
        none = F.array().cast("array<struct<name:string,value:double>>")
        present = lambda x, made: A.let(x, lambda v: F.when(v.isNotNull(), made(v)).otherwise(none))
        parts = [present(_moved(found), moves)]
        parts += [present(first_signal(found, names), lambda x, p=prefix, s=slope: channel(p, s, x)) for prefix, names, slope in _CUES]
        return F.array_sort(F.filter(F.concat(*parts), lambda c: c["value"].isNotNull()))

    return A.let(keyed(signals), all_cues)


def _kernel(kind: str, rate: int, x: Column) -> Column:
    """The features of a channel whose kernel filters, as ``map<string,double>``."""

    @F.pandas_udf("map<string,double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([{} if v is None or not len(v) else dsp.KERNELS[kind](v, rate) for v in rows])

    return run(x)


def _peaks(rate: int, axes: Column) -> Column:
    """The main frequency of each axis."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else [dsp.peak_frequency(a, rate) for a in v] for v in rows])

    return run(axes)


def _map(place: str, names: tuple[str, ...], values: list[Column]) -> Column:
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    pairs = zip(names, values, strict=True)
    return F.create_map(*(c for k, v in pairs for c in (F.lit(f"{place}_{k}"), finite(v.cast("double")))))


def _prefixed(place: str, values: Column) -> Column:
    return F.transform_keys(values, lambda k, v: F.concat(F.lit(f"{place}_"), k))


def _acc_features(place: str, axes: Column, peaks: Column, rate: int) -> Column:
    """Level, spread, area and main frequency of each axis, and of the magnitude but its frequency; null without axes."""
    values = []
    for i in range(3):
        x = F.get(axes, F.lit(i))
        values += [A.mean(x), A.std(x), A.absolute_integral(x, rate), F.get(peaks, F.lit(i))]
    size = A.magnitude(*(F.get(axes, F.lit(i)) for i in range(3)))
    return _map(place, dsp.ACC, [*values, A.mean(size), A.std(size), A.absolute_integral(size, rate)])


def _temp_features(place: str, x: Column, rate: int) -> Column:
    """Level, spread, extremes and slope."""
    return _map(place, dsp.TEMP, [A.mean(x), A.std(x), F.array_min(x), F.array_max(x), F.array_max(x) - F.array_min(x), A.slope(x, float(rate))])


def with_stress_features(df: DataFrame, signals: str = "signals", out: str = "values") -> DataFrame:
    """``out``: the physiological values of a stress window as ``map<string,double>``; null where a channel is too short.

    Missing and empty channels have no values. Statistics are Column expressions; kernels that filter or detect
    beats run per channel on Arrow batches. Of accelerometers the middle five seconds count: 10 samples or more of
    three axes of one length.
    """
    ensure()
    names, none = df.columns, F.create_map().cast("map<string,double>")
    own = lambda c: F.get(F.filter(signals, lambda v: (v["name"] == c) & (F.size(v["x"]) > 0)), F.lit(0))
    df = df.withColumns({f"_own_{c}": own(c) for c, _, _ in dsp.STRESS})
    crops, calls, maps = {}, {}, []
    for channel, kind, rate in dsp.STRESS:
        if kind == "acc":
            axes = [A.centre_crop(F.col(f"_own_{channel}")[k], 5 * rate) for k in "xyz"]
            n = F.size(axes[0])
            fits = F.coalesce((n >= 10) & (n == F.size(axes[1])) & (n == F.size(axes[2])), F.lit(False))
            crops[f"_axes_{channel}"] = F.when(fits, F.array(*axes))
            calls[f"_made_{channel}"] = _peaks(rate, F.col(f"_axes_{channel}"))
        elif kind != "temp":
            calls[f"_made_{channel}"] = _kernel(kind, rate, F.col(f"_own_{channel}")["x"])
    df = df.withColumns(crops).withColumns(calls)
    for channel, kind, rate in dsp.STRESS:
        place, s = channel.partition("_")[0], F.col(f"_own_{channel}")
        if kind == "acc":
            found = _acc_features(place, F.col(f"_axes_{channel}"), F.col(f"_made_{channel}"), rate)
        elif kind == "temp":
            found = _temp_features(place, s["x"], rate)
        else:
            found = _prefixed(place, F.col(f"_made_{channel}"))
        maps.append(F.when(s.isNotNull(), found).otherwise(none))
    return df.select(*names, A.kept(F.map_concat(*maps)).alias(out))


def printed_values(values: Column) -> Column:
    """Values of a map with four significant digits, as ``array<struct<name, shown>>`` in its order."""
    one = lambda v: UNAVAILABLE if v is None or v != v else format(v, ".4g")

    @F.pandas_udf("array<struct<name:string,shown:string>>")
    def show(rows: pd.Series) -> pd.Series:
        return pd.Series([[{"name": k, "shown": one(v)} for k, v in (row.items() if row is not None else [])] for row in rows])

    return show(values)


def stress_text(shown: Column) -> Column:
    """Printed values by section, four on a line; ``shown`` is a column."""

    def own(name: Column) -> Column:
        return F.coalesce(*(F.when(name.startswith(p), k) for k, prefixes in STRESS_SECTIONS.items() for p in prefixes), F.lit("Other"))

    def listed(rows: Column) -> Column:
        def section(k: str) -> Column:
            def lines(p: Column) -> Column:
                each = F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(PER_LINE)), lambda i: F.concat(F.lit("- "), F.array_join(F.slice(p, i + 1, F.lit(PER_LINE)), ", ")))
                return F.when(F.size(p) > 0, F.concat(F.lit(f"\n{k}:\n"), F.array_join(each, "\n")))

            return A.let(F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["t"]), lines)

        return F.concat_ws("\n", F.lit(TITLES["WESAD"]), *map(section, [*STRESS_SECTIONS, "Other"]))

    rows = F.transform(shown, lambda v: F.struct(own(v["name"]).alias("k"), F.concat_ws("=", v["name"], v["shown"]).alias("t")))
    return F.when(F.size(shown) > 0, A.let(rows, listed)).otherwise(f"{TITLES['WESAD']}\n- no WESAD signal features available")


def with_feature_text(df: DataFrame, dataset: str | None = None, signals: str = "signals", out: str = "input_text") -> DataFrame:
    """``out``: the feature description of windows of one data set; of none: all channels under the plain title.

    No channels give the text for no signals. Sleep windows without a wearable channel are an error, unknown data
    sets a ValueError. Each step is a column of its own, so what Python prints is computed once.
    """
    ensure()
    key = (dataset or "").replace("-", "").replace("_", "").strip().upper()
    if key not in ("WESAD", "HHAR", "DREAMT", "", "UNKNOWN"):
        raise ValueError(f"unknown dataset: {dataset!r}")
    names = [c for c in df.columns if c != out]
    df = df.withColumn("_signals", F.coalesce(F.col(signals).cast(SIGNALS), F.array().cast(SIGNALS)))
    if key == "WESAD":
        df = with_stress_features(df, "_signals", "_values").withColumn("_shown", printed_values(F.col("_values")))
        return df.select(*names, stress_text(F.col("_shown")).alias(out))
    wanted = {"HHAR": is_motion, "DREAMT": is_sleep}.get(key)
    df = df.withColumn("_own", F.filter("_signals", lambda s: wanted(s["name"])) if wanted else F.col("_signals"))
    df = df.withColumn("_features", A.kept(described_signals(F.col("_own")))).withColumn("_lines", printed(F.col("_features")))
    text = block_text(F.col("_lines"), TITLES.get(key, TITLE), SECTIONS.get(key))
    if key != "DREAMT":
        return df.select(*names, text.alias(out))
    df = df.withColumn("_found", A.kept(sleep_features(F.col("_own")))).withColumn("_cues", printed_cues(F.col("_found"))).withColumn("_text", text)
    whole = F.when(F.size("_cues") > 0, F.concat_ws("\n", "_text", F.lit(f"\n{SLEEP_SECTION}:"), "_cues")).otherwise(F.col("_text"))
    listed = F.array_join(F.transform("_signals", lambda s: s["name"]), ", ")
    none = F.raise_error(F.concat(F.lit("no wearable sleep signal among: "), listed)).cast("string")
    return df.select(*names, F.when(F.size("_own") > 0, whole).otherwise(none).alias(out))
