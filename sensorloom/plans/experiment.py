"""Experiments: configurations, their expansion from a base and a grid, and one run as a plan."""

from __future__ import annotations

import copy
import itertools
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, fingerprints, metrics, sampling
from . import agents, prompts
from .scorer import raise_on_failures, scored

INPUTS = {
    "raw": "raw_data", "raw_data": "raw_data", "feature": "feature_description", "description": "feature_description", "feature_description": "feature_description",
    "embedding": "encoded_time_series", "alignment": "encoded_time_series", "embedding_alignment": "encoded_time_series", "encoded_time_series": "encoded_time_series",
    "knowledge": "extra_knowledge", "extra_knowledge": "extra_knowledge",
}
USAGES = ("direct", "few_shot", "multi_agent")
OUTPUTS = {"label": "label_only", "label_only": "label_only", "label_explanation": "label_explanation"}
SELECTIONS = {
    "leave_one_subject_out": "leave_one_subject_out", "loo": "leave_one_subject_out", "subject_loo": "leave_one_subject_out",
    "class_balanced": "class_balanced", "label_balanced": "class_balanced", "legacy": "class_balanced",
}
DATASETS = {
    "WESAD": {"labels": [0, 1], "loader_kwargs": {"physiology_window_sec": 60.0, "acc_window_sec": 5.0, "stride_sec": 60.0}},
    "HHAR": {"labels": [0, 1], "loader_kwargs": {"window_size": 20, "stride_size": 10, "sampling_rate": 10.0, "min_samples_per_window": 10, "max_gap_sec": 5.0, "include_gyroscope": True}},
    "DREAMT": {"labels": [0, 1], "loader_kwargs": {"sampling_rate": 64, "epoch_seconds": 30.0, "stride_seconds": 30.0, "min_epoch_fraction": 0.8}},
}
#: Subset sizes: rows per label, or subjects and rows per subject and label.
SUBSETS = {
    "debug": {d: {"per_label": 3} for d in DATASETS}, "pilot": {d: {"per_label": 50} for d in DATASETS},
    "main": {"WESAD": {"per_label": 160}, "HHAR": {"subjects": 9, "per_subject_label": 50}, "DREAMT": {"subjects": 100, "per_subject_label": 5}},
}


@dataclass
class Experiment:
    dataset: str = "WESAD"
    input: str = "raw_data"
    usage: str = "direct"
    output: str = "label_only"
    labels: list[int] = field(default_factory=list)
    train_subjects: list[str] | None = None
    test_subjects: list[str] | None = None
    subjects: list[str] | None = None
    subject_split: str = "subject_independent"
    example_selection: str = "leave_one_subject_out"
    example_subjects: int = 3
    examples_per_class: int | None = None
    example_max_chars: int | None = -1
    seed: int = 42
    balanced_per_label: int | None = None
    per_subject_limit: int | None = None
    limit: int | None = None
    concurrency: int = 8
    cost: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.dataset = prompts.normal_dataset(self.dataset)
        key = lambda v: str(v).strip().lower().replace("-", "_")
        self.input, self.usage, self.output = INPUTS.get(key(self.input), ""), key(self.usage), OUTPUTS.get(key(self.output), "")
        for name, value, known in (("dataset", self.dataset, DATASETS), ("input", self.input, INPUTS.values()), ("usage", self.usage, USAGES), ("output", self.output, OUTPUTS.values())):
            if value not in known:
                raise ValueError(f"unknown {name}: {value!r}")
        if self.examples_per_class is None:
            self.examples_per_class = 1 if self.long else 2
        if self.example_max_chars is not None and self.example_max_chars < 0:
            self.example_max_chars = 800 if self.long else None
        self.example_selection = SELECTIONS.get(key(self.example_selection), "")
        if not self.example_selection:
            raise ValueError(f"unknown selection of examples; known: {', '.join(sorted(SELECTIONS))}")
        if self.usage == "few_shot" and (self.example_subjects < 1 or self.examples_per_class < 1):
            raise ValueError("few-shot needs at least one example subject and one example per class")
        self.labels = list(self.labels or DATASETS[self.dataset]["labels"])

    @property
    def name(self) -> str:
        return f"{self.dataset}_{self.input}_{self.usage}_{self.output}".lower()

    @property
    def long(self) -> bool:
        """Whether inputs are long: fewer and shorter examples, more time."""
        return self.input != "feature_description"

    @property
    def client(self) -> dict:
        """What a client is given: seconds a call may take, and tokens of an answer."""
        return {"timeout": 1200.0 if self.usage == "multi_agent" else 600.0 if self.long else 300.0, "max_tokens": 256 if self.explain else 128}

    def resolved_subjects(self, available: list[str]) -> tuple[list[str] | None, list[str] | None]:
        """Train and test subjects of a run; None is all.

        Independent subjects: lists that share none, a missing one completed from ``subjects`` or all available;
        direct and multi-agent runs may name ``subjects`` alone. ``all``: no split, but for few-shot runs whose
        examples are the same for all samples.
        """
        apart = self.usage == "few_shot" and self.example_selection == "class_balanced"
        if self.subject_split not in ("all", "subject_independent"):
            raise ValueError(f"unknown split of subjects: {self.subject_split!r}")
        whole = self.subject_split == "all" and not apart
        if whole or (self.subject_split != "all" and self.usage != "few_shot" and self.subjects and not self.test_subjects):
            return self.train_subjects, self.subjects
        train, test = sampling.split_subjects(self.subjects or available, self.train_subjects, self.test_subjects)
        if not test or (apart and not train):
            raise ValueError("a split needs subjects on both sides")
        return train, test

    @property
    def explain(self) -> bool:
        return self.output == "label_explanation"


def load_config(path: str) -> dict:
    """A JSON or YAML object; a byte-order mark is allowed."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yml", ".yaml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a configuration is an object")
    return found


def merged(base: dict, change: dict) -> dict:
    """Deep merge; dotted keys of ``change`` name nested places."""
    out = copy.deepcopy(base)
    for key, value in change.items():
        at, *rest = str(key).split(".", 1)
        if rest:
            out[at] = merged(out.get(at) if isinstance(out.get(at), dict) else {}, {rest[0]: value})
        elif isinstance(value, dict) and isinstance(out.get(at), dict):
            out[at] = merged(out[at], value)
        else:
            out[at] = copy.deepcopy(value)
    return out


def expanded(config: dict) -> list[dict]:
    """The configurations of a file: a single one, or a base with experiments, or with every combination of a grid."""
    base = config.get("base") or {k: v for k, v in config.items() if k not in ("experiments", "grid", "base")}
    if config.get("experiments"):
        return [merged(base, e) for e in config["experiments"]]
    if config.get("grid"):
        keys = list(config["grid"])
        return [merged(base, dict(zip(keys, values))) for values in itertools.product(*config["grid"].values())]
    return [base]


def matrix(**common) -> list[Experiment]:
    """All datasets, inputs, usages and outputs: 72 experiments."""
    inputs = list(dict.fromkeys(INPUTS.values()))
    return [Experiment(d, i, u, o, **common) for d in DATASETS for i in inputs for u in USAGES for o in ("label_only", "label_explanation")]


def run(e: Experiment, samples: DataFrame, call, root: str, pool: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and metrics of one experiment. ``samples``: sample_id, subject, label, input_text (and input_views).

    ``pool`` holds few-shot examples, ``samples`` by default. Answers are kept below ``root``: a run that failed asks only
    for what it lacks.
    """
    rows = sampling.balanced_limit(samples, "label", "subject", "sample_id", e.balanced_per_label, e.per_subject_limit, e.limit, e.seed)
    if e.usage == "multi_agent":
        done = agents.run(rows, "sample_id", e.dataset, e.labels, call, root, e.explain)
    else:
        if e.usage == "direct":
            asked = rows.withColumn("prompt", prompts.direct(e.dataset, e.labels, e.input, F.col("input_text"), e.explain))
        else:
            asked = _few_shot(e, rows, pool if pool is not None else samples)
        done = scored(asked, call, f"{root}/answers", e.concurrency)
    raise_on_failures(done, "sample_id")
    got = done.withColumn("p", answers.parsed(F.col("response"), e.labels, e.explain))
    got = got.select(*[c for c in done.columns if c not in ("prompt", "input_views")], F.col("p.label").alias("y_pred"), F.col("p.valid").alias("valid"), "p.parse_error", "p.explanation")
    got = got.withColumn("y_true", F.col("label")).withColumn("y_wrong", metrics.invalid_as_wrong(F.col("label"), F.col("y_pred"), e.labels))
    valid = metrics.scores(got.filter("valid"), "y_true", "y_pred", e.labels)
    strict = metrics.scores(got, "y_true", "y_wrong", e.labels)
    strict = strict.select(*(F.col(c).alias(f"strict_{c}") for c in strict.columns))
    return got, valid.crossJoin(strict).crossJoin(metrics.validity(got, F.col("valid")).select("invalid_n", "invalid_rate"))


def _few_shot(e: Experiment, rows: DataFrame, pool: DataFrame) -> DataFrame:
    n, shown = e.examples_per_class, (e.dataset, e.example_max_chars, e.explain)
    pool = pool if "dataset" in pool.columns else pool.withColumn("dataset", F.lit(e.dataset))
    if e.example_selection == "class_balanced":
        shots = fingerprints.class_balanced(pool, "label", e.labels, n, e.seed).withColumn("_g", F.lit(0))
        blocks = prompts.example_blocks(shots, "_g", ["place"], "input_text", "label", *shown)
        only = blocks.select("examples").first()["examples"]  # the same few examples for every sample
        return prompts.few_shot_with(rows, only, e.dataset, e.labels, e.input, e.explain)
    good = sampling.complete_subjects(pool, "subject", "label", e.labels, n)
    found = sampling.other_subjects(rows.select("subject").distinct(), good, "subject", e.example_subjects, e.seed)
    few = found.groupBy("eval_subject").count().filter(F.col("count") < e.example_subjects)
    if few.limit(1).count() or good.limit(e.example_subjects + 1).count() < e.example_subjects:
        raise sampling.Shortage(f"fewer than {e.example_subjects} other subjects with {n} examples of every label")
    shots = fingerprints.leave_one_out(found, pool.filter(F.col("label").isin(e.labels)), "subject", "label", n, e.seed)
    blocks = prompts.example_blocks(shots, "eval_subject", ["subject_rank", "label", "rn"], "input_text", "label", *shown)
    return prompts.few_shot(rows, blocks, "subject", "eval_subject", e.dataset, e.labels, e.input, e.explain)
