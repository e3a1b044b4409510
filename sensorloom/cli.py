"""Command line: make caches from recordings, texts from caches and subsets; run experiments, list the matrix, count samples."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import metrics
from .plans import experiment, materialise
from .plans.scorer import Client, MockScorer
from .sources import recordings, store


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sensorloom")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run", help="run the experiments of a configuration over a cache of texts")
    r.add_argument("--config", required=True)
    r.add_argument("--cache", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--base-url", help="an OpenAI-compatible endpoint; a mock scorer without it")
    r.add_argument("--model", default="")
    r.add_argument("--train-cache", help="the cache of few-shot examples; that of --cache without it")
    r.add_argument("--gpu-csv", help="telemetry of the run's machine, for its cost profile")
    sub.add_parser("matrix", help="list all experiments")
    c = sub.add_parser("count", help="count the samples of a cache by subject and label")
    c.add_argument("--cache", required=True)
    c.add_argument("--out", help="a folder for CSV files; printed row by row without it")
    w = sub.add_parser("windows", help="recordings to a cache of windows, and of texts for each input named")
    w.add_argument("--dataset", required=True)
    w.add_argument("--root", required=True)
    w.add_argument("--input", nargs="*", default=[])
    w.add_argument("--settings", default="{}", help="JSON: window lengths, rates, strides")
    w.add_argument("--shard-by-subject", action="store_true", help="build subject by subject; a build that stopped goes on")
    w.add_argument("--subjects", nargs="*", help="only these")
    t = sub.add_parser("texts", help="caches of windows to one cache of texts")
    t.add_argument("--input", required=True)
    t.add_argument("--knowledge-file")
    t.add_argument("--knowledge-text", default="")
    t.add_argument("--knowledge-mode", choices=("default", "append", "replace"))
    b = sub.add_parser("subset", help="a reproducible subset of one or more caches")
    b.add_argument("--level", required=True, choices=tuple(experiment.SUBSETS))
    b.add_argument("--seed", type=int, default=42)
    for x in (t, b):
        x.add_argument("--cache", nargs="+", required=True)
    for x in (w, t, b):
        x.add_argument("--out", required=True)
        x.add_argument("--overwrite", action="store_true")
    a = p.parse_args(args)
    if a.command == "matrix":
        print("\n".join(e.name for e in experiment.matrix()))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "count":
        counts = metrics.label_distribution(store.load(spark, a.cache), "label", ["subject"]).orderBy("subject", "label")
        if a.out:
            counts.write.mode("overwrite").option("header", True).csv(a.out)
        for row in [] if a.out else counts.toLocalIterator():
            print("\t".join(map(str, row)))
        return 0
    if a.command == "windows":
        settings = json.loads(a.settings) | ({"subjects": a.subjects} if a.subjects else {})
        made = materialise.from_raw(spark, a.dataset, a.root, a.out, a.input, a.overwrite, a.shard_by_subject, **settings)
        print(json.dumps({k: m.sample_count for k, m in made.items()}))
        return 0
    if a.command == "texts":
        extra = {"text": a.knowledge_text, "path": a.knowledge_file, "mode": a.knowledge_mode} if a.knowledge_text or a.knowledge_file or a.knowledge_mode else {}
        print(json.dumps({"samples": materialise.from_caches(spark, a.cache, a.input, a.out, a.overwrite, **extra).sample_count}))
        return 0
    if a.command == "subset":
        print(json.dumps({"samples": materialise.save_subset(spark, a.cache, a.level, a.out, a.seed, a.overwrite).sample_count}))
        return 0
    telemetry = recordings.gpu_summary(recordings.read_gpu(spark, a.gpu_csv)) if a.gpu_csv else None
    for config in experiment.expanded(experiment.load_config(a.config)):
        e = experiment.Experiment(**config)
        made = store.load_manifest(spark, a.cache)
        store.validate(made, e.dataset, e.input, {})
        train, test = e.resolved_subjects(made.subjects)
        rows = store.load(spark, a.cache, test, e.labels)
        # examples that leave the evaluated subject out may come from any other
        own = train if e.example_selection == "class_balanced" else None
        pool = store.load(spark, a.train_cache or a.cache, own, e.labels) if e.usage == "few_shot" else None
        call = Client(a.base_url, a.model, **e.client) if a.base_url else MockScorer()
        predictions, scores = experiment.run(e, rows, call, f"{a.out}/{e.name}", pool)
        predictions.write.mode("overwrite").parquet(f"{a.out}/{e.name}/predictions")
        usage = metrics.usage_summary(metrics.folded_usage(spark.read.parquet(f"{a.out}/{e.name}/predictions"), "sample_id"))
        if e.cost:
            usage = metrics.with_cost(usage, "total_prompt_tokens", "total_completion_tokens", e.cost.get("input", 0.0), e.cost.get("output", 0.0))
            usage = metrics.with_scaling(usage, e.cost.get("samples", made.sample_count))
        found = metrics.cost_profile(usage, scores, telemetry).first().asDict()
        store.write_json(found | {"run": e.name}, f"{a.out}/{e.name}_metrics.json")
        print(json.dumps({"run": e.name, "accuracy": found["accuracy"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
