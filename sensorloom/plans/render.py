"""Windows as text: raw sequences, feature lines, encoded patterns, added knowledge.

A window's channels come as ``signals array<struct<name,x,y,z>>`` (y and z null for one axis). Numbers are
printed by Arrow-batched UDFs, everything around them is Column expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.text import formatted, rounded_list
from ..ship import ensure

# Values printed per channel of the stress recordings, and of any other channel.
STRESS_LENGTHS = {
    "chest_ecg": 80, "chest_eda": 40, "chest_resp": 60, "chest_emg": 40, "chest_temp": 20, "wrist_bvp": 60, "wrist_eda": 40,
    "wrist_temp": 20,
}
ACC_LENGTH, OTHER_LENGTH, MOST_CHANNELS = 40, 48, 12
SLEEP_NAMES = ("eda", "gsr", "bvp", "ppg", "pulse", "hr", "ibi", "temp", "acc", "acc_x", "acc_y", "acc_z")
SLEEP_PARTS = "heart_rate|skin_temp|temperature|actigraphy|activity|motion|accelerometer"


def feature_line(name: str, stats: Column) -> Column:
    """``- name: mean=0.125, …``; ``stats`` is a column that holds :func:`arrays.described`, not the expression."""
    parts = [F.lit(f"- {name}: ")]
    for i, k in enumerate(("mean", "std", "min", "max", "p25", "p75")):
        parts += [F.lit(f"{', ' if i else ''}{k}="), formatted(stats[k], ".3f")]
    return F.concat(*parts, F.lit(", trend="), stats["trend"])


def is_motion(name: Column) -> Column:
    lower = F.lower(name)
    return lower.rlike("acc|gyro") | lower.isin("x", "y", "z")


def is_sleep(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), "[- ]", "_")
    return key.isin(*SLEEP_NAMES) | key.rlike(SLEEP_PARTS)


def packed(x: Column, length: int) -> Column:
    """Standardised, thinned and printed with three places."""
    return rounded_list(A.downsampled(A.zscore(A.clean(x)), length))


def raw_block(signals: Column, dataset: Column) -> Column:
    """The raw-sequence text of a window; the stress recordings have a fixed layout, others their first channels by name."""
    ensure()

    @F.pandas_udf("string")
    def show(rows: pd.Series, datasets: pd.Series) -> pd.Series:
        return pd.Series([_stress_text(r) if str(d).upper() == "WESAD" else _other_text(r) for r, d in zip(rows, datasets)])

    return show(signals, dataset)


def _thin(values, length: int) -> list[float]:
    import numpy as np

    x = np.asarray([] if values is None else values, np.float32)
    x = x[np.isfinite(x)]
    if not len(x):
        return []
    s = x.std()
    x = x - x.mean() if s < 1e-8 else (x - x.mean()) / s
    if len(x) > length:
        x = x[np.linspace(0, len(x) - 1, length).astype(int)]
    return [round(float(v), 3) for v in x]


def _axes(signal, length: int) -> dict[str, list[float]]:
    return {k: _thin(signal[k], length) if signal is not None else [] for k in ("x", "y", "z")}


def _stress_text(signals) -> str:
    by_name = {s["name"]: s for s in (signals if signals is not None else [])}
    lines = ["Input raw sequences:", ""]
    for name, length in STRESS_LENGTHS.items():
        if name == "wrist_bvp":
            lines += [f"chest_acc = {json.dumps(_axes(by_name.get('chest_acc'), ACC_LENGTH))}", ""]
        lines.append(f"{name} = {_thin(by_name[name]['x'], length) if name in by_name else []}")
    return "\n".join([*lines, f"wrist_acc = {json.dumps(_axes(by_name.get('wrist_acc'), ACC_LENGTH))}"])


def _other_text(signals) -> str:
    rows = sorted(signals if signals is not None else [], key=lambda s: s["name"])
    lines, used = [], 0
    for s in rows:
        if used >= MOST_CHANNELS:
            lines.append(f"... {len(rows) - used} additional channel(s) omitted for prompt length.")
            break
        if s["y"] is not None:
            lines.append(f"{s['name']} = {json.dumps(_axes(s, OTHER_LENGTH))}")
            used += 1
        elif thin := _thin(s["x"], OTHER_LENGTH):
            lines.append(f"{s['name']} = {thin}")
            used += 1
    return "\n".join(["Input raw sequences:", *(lines or ["No numeric raw sensor channel was available."])])


def channel_tag(name: Column, place: Column) -> Column:
    """``CHEST_EDA_CHANNEL`` of a channel at a place, ``EDA_CHANNEL`` where the place is unknown."""
    key = lambda c: F.upper(F.trim(F.translate(c, "- ", "__")))
    there = F.when(~key(place).isin("", "UNKNOWN"), key(place))
    return F.concat_ws("_", there, key(name), F.lit("CHANNEL"))


def encoded_channel(channel: Column, stats: Column) -> Column:
    """The tagged block of temporal patterns of one channel: ``struct<channel, sensor, place, rate, x>`` of finite values, its
    rate in Hz, null if unknown; ``stats``: of :func:`supporting`."""
    name, sensor, place, rate = (channel[k] for k in ("channel", "sensor", "place", "rate"))
    tag = channel_tag(name, place)
    whole = rate.cast("bigint")
    shown = F.when(rate == whole, whole.cast("string")).otherwise(rate.cast("string"))
    hz = F.coalesce(F.concat(shown, F.lit(" Hz")), F.lit("unknown"))

    def block(z: Column) -> Column:
        trend, parts = A.edge_trend(z), A.segment_trends(z)
        level, period, events = A.fluctuation(z), A.periodicity(z), A.event_counts(z)
        peaks, jumps = events["peaks"], events["changes"]
        seen = (
            F.when(F.size(z) < 3, F.lit("insufficient evidence")).when((peaks == 0) & (jumps == 0), F.lit("no strong sudden change detected"))
            .when((peaks > 0) & (jumps > 0), F.concat(peaks.cast("string"), F.lit(" prominent peak/valley event(s) with "), jumps.cast("string"), F.lit(" abrupt change point(s)")))
            .when(peaks > 0, F.concat(peaks.cast("string"), F.lit(" prominent peak/valley event(s)")))
            .otherwise(F.concat(jumps.cast("string"), F.lit(" abrupt change point(s)")))
        )
        cue = (
            F.when((peaks > 0) | (jumps > 0), "transient event-driven temporal variation")
            .when(period.isin("strong", "moderate"), "repeating oscillatory temporal pattern")
            .when(trend == "increasing", "gradual upward temporal shift").when(trend == "decreasing", "gradual downward temporal shift")
            .when(level == "high", "irregular high-variation temporal activity").otherwise("mostly stable temporal profile")
        )
        named = F.array_join(F.transform(parts, lambda t, i: F.concat(F.lit("segment "), (i + 1).cast("string"), F.lit(" is "), t)), ", ")
        article = F.when(trend == "increasing", "an").otherwise("a")
        lines = [
            F.lit("<"), tag, F.lit(">\nChannel: "), name, F.lit("\nSensor type: "), sensor, F.lit("\nBody location: "), place,
            F.lit("\nSampling rate: "), hz, F.lit("\n\nQuestion: What is the temporal pattern of this sensor signal?\nAnswer:\nThe signal shows "), article, F.lit(" "), trend,
            F.lit(" temporal pattern. Across temporal segments, "), named, F.lit(". The fluctuation level is "), level,
            F.lit(", periodicity is "), period, F.lit(", and "), seen, F.lit(".\n\nEncoded temporal pattern:\n- Global trend: "), trend,
            F.lit("\n- Segment-level trend: "), named, F.lit("\n- Fluctuation level: "), level, F.lit("\n- Periodicity: "), period,
            F.lit("\n- Sudden changes or peaks: "), seen, F.lit("\n- Dynamic cue: "), cue, F.lit("\n\nSupporting statistics:\nmean="),
        ]
        return F.concat(*lines)

    head = A.let(A.zscore(A.downsampled(channel["x"], 256), zeros=True), block)
    return F.concat(head, stats, F.lit("\n</"), tag, F.lit(">"))


def supporting(channels: Column) -> Column:
    """Of each channel mean, std, min and max with four significant digits."""

    @F.pandas_udf("array<string>")
    def show(rows: pd.Series) -> pd.Series:
        import numpy as np

        def line(x) -> str:
            v = np.asarray(x, float)
            return f"{v.mean():.4g}, std={v.std():.4g}, min={v.min():.4g}, max={v.max():.4g}"

        return pd.Series([[line(c["x"]) for c in (row if row is not None else [])] for row in rows])

    return show(channels)


def encoded_text(blocks: Column) -> Column:
    """The whole encoded representation from its channel blocks."""
    head = "Input representation: Encoded Time-series\nThis input describes channel-aware and segment-level temporal patterns.\nThe ground-truth label is not included.\n\n"
    tail = "\n\nTask:\nBased only on the encoded time-series representation above, predict the class label."
    body = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise("No valid numeric sensor channel was available for encoded time-series analysis.")
    return F.concat(F.lit(head), body, F.lit(tail))


def with_knowledge(features: Column, knowledge: str, context: str = "") -> Column:
    """A feature text followed by knowledge lines; neither may be empty."""
    if not knowledge.strip():
        raise ValueError("knowledge is empty")
    lines = "\n".join(f"- {x.strip()}" for x in knowledge.splitlines() if x.strip())
    return F.concat(features, F.lit(f"\n\n{context}\n\nExtra knowledge:\n{lines}" if context else f"\n\nExtra knowledge:\n{lines}"))
