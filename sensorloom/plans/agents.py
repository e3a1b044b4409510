"""Multi-agent classification: one row per agent call, a vote, then the judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import answers, metrics
from . import prompts
from .scorer import scored

# The agents, what they look at, and how freely they sample.
VIEWS = {
    "signal_pattern_agent": ["raw_data", "encoded_time_series"], "feature_statistic_agent": ["feature_description"],
    "knowledge_agent": ["extra_knowledge"], "label_rule_agent": ["metadata"],
}
HEAT = {"signal_pattern_agent": 0.2, "feature_statistic_agent": 0.2, "knowledge_agent": 0.2, "label_rule_agent": 0.0}
FOCUS = {
    "signal_pattern_agent": "Inspect raw temporal patterns and encoded time-series representations. Focus on trends, bursts, stability, movement-like patterns, artifacts, and temporal consistency.",
    "feature_statistic_agent": "Inspect statistical feature descriptions. Focus on mean, standard deviation, range, frequency-domain features, cross-channel consistency, and feature-level evidence.",
    "knowledge_agent": "Inspect extra knowledge provided for the sample. Use it only as supporting context, not as a replacement for the actual dataset label rules.",
    "label_rule_agent": "Apply the dataset-specific label definition strictly using only label rules and safe sample metadata. Do not infer from unavailable raw signals, feature values, or external knowledge.",
}
OTHER_FOCUS = "Analyze the assigned input view independently and produce a label prediction with evidence."
ALL_VIEWS = ["raw_data", "encoded_time_series", "feature_description", "extra_knowledge"]
#: Metadata that cannot give the label away: the only keys an agent may see.
SAFE = ("dataset", "subject", "window_start_sec", "window_end_sec", "sampling_rate", "input_type")


def metadata(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(F.col(c) for c in SAFE if c in columns)))


def _source(views: Column, wanted: list[str], meta: Column, text: Column) -> Column:
    if wanted == ["metadata"]:
        return meta
    blocks, missing = [], []
    for v in wanted:
        value = F.try_element_at(views, F.lit(v))
        there = F.coalesce(F.trim(value) != "", F.lit(False))
        blocks.append(F.when(there, F.concat(F.lit(f"### {v}\n"), value)))
        missing.append(F.when(~there, F.lit(v)))
    held = F.filter(F.array(*blocks), lambda x: x.isNotNull())
    gone = F.filter(F.array(*missing), lambda x: x.isNotNull())
    named = F.concat(F.lit('### missing_input_views\n["'), F.array_join(gone, '", "'), F.lit('"]'))
    parts = F.concat(held, F.when(F.size(gone) > 0, F.array(named)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.concat(F.lit("### fallback_selected_input\n"), text))


def calls(samples: DataFrame, dataset: str, labels: list[int], views: dict[str, list[str]] = VIEWS) -> DataFrame:
    """One row per sample and agent: ``agent, temperature, prompt``. ``samples``: ``input_views``, ``input_text`` and metadata."""
    meta = metadata(samples.columns)
    rows = []
    for agent, wanted in views.items():
        head = (
            f"You are one independent agent in a multi-agent classification system.\n\nAgent name:\n{agent}\n\nAgent focus:\n{FOCUS.get(agent, OTHER_FOCUS)}\n\n"
            "Task:\nClassify the current time-series sample from your assigned input view.\n\nAssigned input view:\n"
        )
        tail = (
            f"\n\nLabels:\n{prompts.label_block(labels, dataset)}\n\nDataset-specific label rules:\n{prompts.rules_block(dataset)}\n\n"
            f"Decision calibration:\n{prompts.guidance_block(dataset)}\n\nOutput JSON only, with the key \"predicted_label\": one of {', '.join(map(str, labels))}."
        )
        source = _source(F.col("input_views"), wanted, meta, F.col("input_text"))
        rows.append(F.struct(F.lit(agent).alias("agent"), F.lit(HEAT.get(agent, 0.0)).alias("temperature"), F.concat(F.lit(head), source, F.lit(tail)).alias("prompt")))
    return samples.select("*", F.explode(F.array(*rows)).alias("_c")).select(*samples.columns, "_c.*")


def run(samples: DataFrame, key: str, dataset: str, labels: list[int], call, root: str, explain: bool = False) -> DataFrame:
    """Agents, majority and judge: ``samples`` with ``majority_vote``, ``trace`` and the judge's answer and usage.

    The answers of each stage are kept below ``root``, so neither a lost executor nor a second run repeats a call.
    """
    stage = calls(samples.select(key, *[c for c in samples.columns if c != key]), dataset, labels)
    done = scored(stage.select(key, "agent", "temperature", "prompt"), call, f"{root}/agents", temperature="temperature", by=[key])
    voted = done.withColumn("vote", answers.votes(F.col("response"), labels))
    top = metrics.majority(voted, key, "vote", labels)
    one = F.struct("agent", "vote", "response")
    trace = voted.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("agent_outputs"))
    joined = samples.join(trace, key).join(top, key, "left")
    text = F.array_join(F.transform(F.array(*map(F.lit, ALL_VIEWS)), lambda v: F.coalesce(F.concat(F.lit("### "), v, F.lit("\n"), F.try_element_at("input_views", v)), F.lit(""))), "\n\n")
    head = f"You are the final judge in a multi-view multi-agent classification system.\n\nLabels:\n{prompts.label_block(labels, dataset)}\n\nDataset-specific label rules:\n{prompts.rules_block(dataset)}\n\nDecision calibration:\n{prompts.guidance_block(dataset)}\n\nAll available input views:\n"
    prompt = F.concat(F.lit(head), text, F.lit("\n\nIndependent agent outputs:\n"), F.to_json("agent_outputs"), F.lit("\n\nParsed majority vote:\n"), F.coalesce(F.col("majority_vote").cast("string"), F.lit("unknown")), F.lit("\n\n" + prompts.instructions(labels, explain)))
    judged = scored(joined.select(key, prompt.alias("prompt")), call, f"{root}/judge", by=[key])
    return joined.join(judged.drop("prompt"), key)
