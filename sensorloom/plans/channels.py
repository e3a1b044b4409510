"""What is known of channels: their name in texts, sensor, place and rate, from tables or from their own names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..functions.cleaning import lookup

_MOTION = [(f"{k}_{a}", f"{k.upper()}_{a.upper()}", s) for k, s in (("acc", "accelerometer"), ("gyro", "gyroscope")) for a in "xyz"]
# Key of a channel, its name, sensor, place and rate in Hz, by data set.
WESAD = {
    **{f"{p}_acc_{a}": (f"ACC_{a.upper()}", "accelerometer", p, r) for p, r in (("chest", 700.0), ("wrist", 32.0)) for a in "xyz"},
    "chest_eda": ("EDA", "electrodermal activity", "chest", 700.0), "chest_temp": ("TEMP", "temperature", "chest", 700.0),
    "chest_ecg": ("ECG", "electrocardiography", "chest", 700.0), "chest_emg": ("EMG", "electromyography", "chest", 700.0),
    "chest_resp": ("RESP", "respiration", "chest", 700.0), "wrist_eda": ("EDA", "electrodermal activity", "wrist", 4.0),
    "wrist_temp": ("TEMP", "temperature", "wrist", 4.0), "wrist_bvp": ("BVP", "blood volume pulse", "wrist", 64.0),
}
DREAMT = {
    **{k: (n, s, "wrist", 64.0) for k, n, s in _MOTION[:3]}, "acc": ("ACC", "accelerometer", "wrist", 64.0),
    "actigraphy": ("ACTIGRAPHY", "activity magnitude", "wrist", 64.0), "eda": ("EDA", "electrodermal activity", "wrist", 64.0),
    "eda_lowpass": ("EDA", "low-pass electrodermal activity", "wrist", 64.0), "bvp": ("BVP", "blood volume pulse", "wrist", 64.0),
    "bvp_filt": ("BVP", "filtered blood volume pulse", "wrist", 64.0), "ibi": ("IBI", "inter-beat interval", "wrist", 64.0),
    "hr": ("HR", "heart rate", "wrist", 64.0), "temp": ("TEMP", "skin temperature", "wrist", 64.0), "skin_temp": ("TEMP", "skin temperature", "wrist", 64.0),
}
HHAR = {
    **{k: (n, s, "mobile device", 10.0) for k, n, s in _MOTION}, "acc": ("ACC", "accelerometer", "mobile device", 10.0),
    "acc_mag": ("ACC_MAG", "acceleration magnitude", "mobile device", 10.0), "gyro": ("GYRO", "gyroscope", "mobile device", 10.0),
    "gyro_mag": ("GYRO_MAG", "gyroscope magnitude", "mobile device", 10.0),
}
TABLES = {"WESAD": WESAD, "DREAMT": DREAMT, "HHAR": HHAR}
# Parts of a channel's own name that tell its kind, the first that fits.
KINDS = (
    ("eda", "EDA", "electrodermal activity"), ("temp", "TEMP", "temperature"), ("bvp", "BVP", "blood volume pulse"), ("ecg", "ECG", "electrocardiography"),
    ("emg", "EMG", "electromyography"), ("resp", "RESP", "respiration"), ("^hr$|heart_rate", "HR", "heart rate"), ("ibi", "IBI", "inter-beat interval"),
    ("actigraphy|activity|motion", "ACTIGRAPHY", "activity magnitude"), *((f"gyro_{a}", f"GYRO_{a.upper()}", "gyroscope") for a in "xyz"),
    *((f"acc_{a}|_{a}$", f"ACC_{a.upper()}", "accelerometer") for a in "xyz"),
)


def channel_key(name: Column) -> Column:
    return F.lower(F.trim(F.translate(name, "- ", "__")))


def inferred(key: Column) -> Column:
    """``struct<channel, sensor, place, rate>`` from a channel's key alone; null if it tells nothing."""
    place = F.when(key.contains("chest"), "chest").when(key.contains("wrist"), "wrist").otherwise("unknown")
    name, sensor = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, n, s in reversed(KINDS):
        name, sensor = F.when(key.rlike(pattern), n).otherwise(name), F.when(key.rlike(pattern), s).otherwise(sensor)
    made = F.struct(name.alias("channel"), sensor.alias("sensor"), place.alias("place"), F.lit(None).cast("double").alias("rate"))
    return F.when(name.isNotNull(), made)


def described(key: Column, dataset: str | None, more: dict[str, dict] | None = None) -> Column:
    """``struct<channel, sensor, place, rate>`` of a channel: of ``more``, the data set's table, or its own name."""
    table = {k: dict(zip(("channel", "sensor", "place", "rate"), v)) for k, v in TABLES.get((dataset or "").upper(), {}).items()}
    for k, v in (more or {}).items():
        table[k.replace("-", "_").replace(" ", "_").strip().lower()] = {
            "channel": v.get("channel", v.get("name", "UNKNOWN")), "sensor": v.get("sensor_type", "unknown"),
            "place": v.get("body_location", v.get("location", "unknown")), "rate": v.get("sampling_rate"),
        }
    if not table:
        return inferred(key)
    part = lambda f, kind: lookup({k: v[f] for k, v in table.items() if v[f] is not None} or {"": ""}, key).cast(kind).alias(f)
    known = F.struct(part("channel", "string"), part("sensor", "string"), part("place", "string"), part("rate", "double"))
    return F.when(key.isin(*table), known).otherwise(inferred(key))


def axes(signals: Column, dataset: str | None, more: dict[str, dict] | None = None) -> Column:
    """``array<struct<channel, sensor, place, rate, x>>``: each axis of each known channel that has finite values."""
    three = lambda s: F.array(*(F.struct(F.concat(s["name"], F.lit(f"_{a}")).alias("name"), s[a].alias("x")) for a in "xyz"))
    one = lambda s: F.array(F.struct(s["name"].alias("name"), s["x"].alias("x")))
    flat = F.flatten(F.transform(signals, lambda s: F.when(s["y"].isNull(), one(s)).otherwise(three(s))))
    known = F.transform(flat, lambda s: F.struct(described(channel_key(s["name"]), dataset, more).alias("m"), clean(s["x"]).alias("x")))
    known = F.filter(known, lambda s: s["m"].isNotNull() & (F.size(s["x"]) > 0))
    parts = ("channel", "sensor", "place", "rate")
    return F.transform(known, lambda s: F.struct(*(s["m"][k].alias(k) for k in parts), s["x"].alias("x")))


def ordered(names: Column, preferred: list[str]) -> Column:
    """Channel names, preferred ones first and in their order, then the others by name."""
    first = F.filter(F.array(*map(F.lit, preferred)), lambda p: F.array_contains(names, p)) if preferred else F.array().cast("array<string>")
    rest = F.array_sort(F.filter(names, lambda n: ~n.isin(*preferred))) if preferred else F.array_sort(names)
    return F.concat(first, rest)
