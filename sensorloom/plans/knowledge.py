"""Feature texts with knowledge of the data set: its context, channels, guidance, and what the user adds."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knowledge of each data set as prompts state it.
_WHOLE = "Treat the dataset knowledge as supporting context, not as a deterministic rule."
KNOWLEDGE = {
    "WESAD": {
        "context": "This dataset contains physiological time-series signals for WESAD binary stress classification. In this experiment, no-stress includes baseline, amusement, meditation, and recovery-like segments; stress means the dedicated stress-task segment only.",
        "channels": [
            "EDA can reflect sympathetic nervous system arousal.",
            "ECG or BVP-related features can reflect heart-related physiological changes.",
            "Respiration features may change under stress or affective load.",
            "Temperature changes are usually slower and should be interpreted together with other channels.",
            "ACC mainly reflects body movement and can indicate motion artifacts.",
            "High absolute EDA, SCR, HR/HRV, EMG, or ACC values can also appear in no-stress windows because subjects have different baselines and may move.",
        ],
        "guidance": [
            "Use the WESAD binary mapping exactly: baseline, amusement, meditation, and recovery-like states are no-stress.",
            "Do not treat physiological arousal as stress unless the evidence is consistent across multiple channels.",
            "Do not classify the state from one physiological feature alone.",
            "Consider whether movement-related features may affect physiological signals.",
            "Use cross-channel consistency as supporting evidence.", _WHOLE,
        ],
    },
    "HHAR": {
        "context": "This dataset contains wearable or smartphone motion time-series for human activity recognition.",
        "channels": [
            "Accelerometer channels describe linear acceleration and motion intensity.", "Gyroscope channels describe rotational movement.",
            "Activity patterns should be inferred from temporal movement patterns, not from a single timestamp.",
            "Device placement, user differences, and orientation may affect signal magnitude.",
        ],
        "guidance": [
            "Motion intensity alone may not uniquely identify the activity.", "Interpret accelerometer and gyroscope information jointly.",
            "Prefer temporal pattern evidence over isolated values.", "Consider user and device variation when interpreting signal magnitude.",
        ],
    },
    "DREAMT": {
        "context": "This dataset contains healthcare or sleep-related time-series signals.",
        "channels": [
            "Sleep-related or healthcare-related states may depend on gradual temporal patterns.",
            "Physiological or wearable features should be interpreted over the full time window.",
            "Single noisy changes should not dominate the decision.", "Individual variation and sensor noise should be considered.",
        ],
        "guidance": ["Use the whole temporal window as evidence.", "Avoid overinterpreting one abnormal value.", "Interpret available channels jointly.", _WHOLE],
    },
    "": {
        "context": "This dataset contains time-series samples for classification.",
        "channels": [
            "Time-series features should be interpreted jointly across available channels.",
            "Mean, variance, range, trend, and fluctuation patterns may provide useful evidence.", "Sensor noise and artifacts should be considered.",
        ],
        "guidance": [
            "Use the current sample features as the primary evidence.", "Use the provided knowledge only as supporting context.",
            "Do not infer the label from one isolated feature.", "Predict only one label from the allowed label set provided by the main prompt.",
        ],
    },
}
BASE = [
    "Use the current sample features as the primary evidence.", "Use the dataset knowledge only as supporting context.",
    "Interpret multiple channels jointly.", "Do not infer the label from one isolated feature.",
    "Predict only one label from the allowed label set provided by the main prompt.",
]
MODES = ("default", "append", "replace")


def external(text: str = "", path: str | None = None) -> str:
    """What the user adds: a UTF-8 file, then the text given with the call. A missing file is an error."""
    parts = [Path(path).read_text(encoding="utf-8")] if path else []
    return "\n\n".join(p.strip() for p in [*parts, text or ""] if p.strip())


def evidence(examples: Column) -> Column:
    """Lines of retrieved examples, ``array<struct<label, feature_summary, similarity_score>>`` (any may be null); null if none."""

    def line(e: Column, i: Column) -> Column:
        parts = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), e[k].cast("string")) for k in ("label", "feature_summary", "similarity_score"))))
        text = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("retrieved example metadata unavailable")
        return F.concat(F.lit("- Retrieved example "), (i + 1).cast("string"), F.lit(": "), text)

    return F.when(F.size(examples) > 0, F.array_join(F.transform(examples, line), "\n"))


HEAD = "[Current Sample Feature Description]\n"


def sections(dataset: str | None, text: str = "", path: str | None = None, mode: str | None = None) -> str:
    """What follows the feature text of every sample of a data set."""
    key = (dataset or "").replace("-", "").replace("_", "").strip().upper()
    key = "" if key == "UNKNOWN" else key
    if key not in KNOWLEDGE:
        raise ValueError(f"unknown dataset: {dataset!r}")
    own, known = external(text, path), KNOWLEDGE[key]
    mode = (mode or ("append" if text.strip() or path else "default")).strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode of knowledge: {mode!r}")
    if mode == "replace" and not own:
        raise ValueError("replacing knowledge needs a text or a file")
    listed = lambda items: "\n".join(f"- {x}" for x in items)
    replaced = mode == "replace"
    guidance = BASE if replaced else [*BASE, *(g for g in known["guidance"] if g not in BASE)]
    parts = [("Dataset Context", "External knowledge supplied for this run." if replaced else known["context"])]
    parts += [] if replaced else [("Dataset / Channel Knowledge", listed(known["channels"]))]
    parts += [("External Knowledge", own)] if own and mode != "default" else []
    parts += [("Decision Guidance", listed(guidance))]
    return "".join(f"\n\n[{title}]\n{body}" for title, body in parts)


def knowledge_text(features: Column, dataset: str | None, text: str = "", path: str | None = None, mode: str | None = None, examples: Column | None = None) -> Column:
    """A feature text in its sections. ``mode``: the data set's knowledge alone (default), with the user's after it
    (append, if there is any), or the user's in its place (replace, which needs some)."""
    own = F.regexp_replace(features, r"^\s+|\s+$", "")
    shown = F.concat(F.lit(HEAD), own, F.lit(sections(dataset, text, path, mode)))
    if examples is None:
        return shown
    return F.concat(shown, F.coalesce(F.concat(F.lit("\n\n[Optional Retrieved Evidence]\n"), evidence(examples)), F.lit("")))
