"""Classification, usage, cost and telemetry summaries: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import persist
from .order_stats import percentiles


def confusion(df: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """Counts for every (true, predicted) pair of ``labels``, zeros included."""
    spark = df.sparkSession
    one = spark.createDataFrame([(v,) for v in labels], f"{truth} int")
    grid = one.select(truth, F.explode(F.array(*map(F.lit, labels))).alias(pred))
    counts = df.filter(F.col(truth).isin(labels) & F.col(pred).isin(labels)).groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(counts).join(grid, [truth, pred], "right").select(truth, pred, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def scores(df: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """Accuracy, macro and weighted F1, and per label precision, recall, F1 and support; 0 where undefined."""
    t, p = F.col(truth), F.col(pred)
    parts = [F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("hits")]
    for v in labels:
        parts += [F.count_if((t == v) & (p == v)).alias(f"tp{v}"), F.count_if(p == v).alias(f"pp{v}"), F.count_if(t == v).alias(f"support_{v}")]
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = df.agg(*parts)
    for v in labels:
        tp, pp, s = F.col(f"tp{v}"), F.col(f"pp{v}"), F.col(f"support_{v}")
        out = out.withColumns({f"precision_{v}": ratio(tp, pp), f"recall_{v}": ratio(tp, s), f"f1_{v}": ratio(2 * tp, pp + s)})
    supports = sum((F.col(f"support_{v}") for v in labels[1:]), F.col(f"support_{labels[0]}"))
    macro = sum((F.col(f"f1_{v}") for v in labels[1:]), F.col(f"f1_{labels[0]}")) / len(labels)
    weighted = sum((F.col(f"f1_{v}") * F.col(f"support_{v}") for v in labels[1:]), F.col(f"f1_{labels[0]}") * F.col(f"support_{labels[0]}"))
    cols = [c for v in labels for c in (f"precision_{v}", f"recall_{v}", f"f1_{v}", f"support_{v}")]
    return out.select("n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), macro.alias("macro_f1"), ratio(weighted, supports).alias("weighted_f1"), *cols)


def invalid_as_wrong(truth: Column, pred: Column, labels: list[int]) -> Column:
    """The prediction, or for invalid ones the first label that is not the truth."""
    wrong = F.coalesce(*(F.when(truth != v, F.lit(v)) for v in labels))
    return F.when(pred.isin(labels), pred).otherwise(wrong)


def validity(df: DataFrame, valid: Column) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(~F.coalesce(valid, F.lit(False)))
    return df.agg(n.alias("n"), (n - bad).alias("valid_n"), bad.alias("invalid_n"), F.coalesce(F.try_divide(bad.cast("double"), n), F.lit(0.0)).alias("invalid_rate"))


def folded_usage(calls: DataFrame, sample: str) -> DataFrame:
    """Per sample: calls, characters, elapsed time, and token sums that are null when no call reports tokens."""
    return calls.groupBy(sample).agg(
        F.count(F.lit(1)).alias("llm_call_count"),
        *(F.sum(c).alias(c) for c in ("prompt_chars", "completion_chars", "total_chars", "prompt_tokens", "completion_tokens", "total_tokens")),
        F.sum("elapsed_time_sec").alias("elapsed_time_sec"),
        F.count("total_tokens").alias("llm_token_usage_available_count"),
        F.count_if(F.col("total_tokens").isNull()).alias("llm_token_usage_missing_count"),
    )


def usage_summary(samples: DataFrame) -> DataFrame:
    """Totals and averages; token averages count only samples that have tokens."""
    n, some = F.count(F.lit(1)), F.count("total_tokens")
    chars = ("prompt_chars", "completion_chars", "total_chars")
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    total = lambda c: c if c.startswith("total") else f"total_{c}"
    average = lambda c, k: F.try_divide(F.sum(c).cast("double"), k)
    none = F.lit(0).cast("bigint")
    return samples.agg(
        F.coalesce(F.sum("llm_call_count"), none).alias("total_llm_calls"),
        *(F.coalesce(F.sum(c), none).alias(total(c)) for c in chars), *(F.sum(c).alias(total(c)) for c in tokens),
        F.coalesce(F.sum("elapsed_time_sec"), F.lit(0.0)).alias("total_elapsed_time_sec"),
        *(average(c, n).alias(f"average_{c}_per_sample") for c in chars),
        *(average(c, some).alias(f"average_{c}_per_sample") for c in tokens),
        average("elapsed_time_sec", n).alias("average_elapsed_time_sec_per_sample"),
        F.coalesce(F.sum("llm_token_usage_available_count"), none).alias("token_usage_available_count"),
        F.coalesce(F.sum("llm_token_usage_missing_count"), none).alias("token_usage_missing_count"),
        some.alias("sample_token_usage_available_count"), (n - some).alias("sample_token_usage_missing_count"),
    )


def with_cost(df: DataFrame, prompt: str, completion: str, input_rate: float, output_rate: float) -> DataFrame:
    """Cost from tokens at prices a million; null where either side is."""
    cost = lambda c, rate: F.col(c).cast("double") / 1_000_000.0 * rate
    out = df.withColumns({"estimated_input_cost": cost(prompt, input_rate), "estimated_output_cost": cost(completion, output_rate)})
    return out.withColumn("estimated_total_cost", F.col("estimated_input_cost") + F.col("estimated_output_cost"))


def with_scaling(summary: DataFrame, planned: int) -> DataFrame:
    """Tokens and cost of ``planned`` samples, from :func:`usage_summary` with costs."""
    n = F.col("sample_token_usage_available_count")
    return summary.withColumns({
        "estimated_total_tokens_for_full_experiment": F.col("average_total_tokens_per_sample") * planned,
        "estimated_total_cost_for_full_experiment": F.try_divide(F.col("estimated_total_cost"), n.cast("double")) * planned,
    })


# Names of telemetry in a cost profile, and the columns of a summary of telemetry.
TELEMETRY = {
    "average_gpu_utilization_pct": "avg_utilization_gpu", "max_gpu_utilization_pct": "max_utilization_gpu",
    "average_memory_utilization_pct": "avg_utilization_memory", "max_memory_utilization_pct": "max_utilization_memory",
    "average_memory_used_mib": "avg_memory_used", "max_memory_used_mib": "max_memory_used", "memory_total_mib": "max_memory_total",
    "average_power_w": "avg_power_draw", "max_power_w": "max_power_draw",
}


def cost_profile(usage: DataFrame, scores: DataFrame, telemetry: DataFrame | None = None) -> DataFrame:
    """One row: a run's scores, its usage (with cost and scaling, if there), and the telemetry of its machine.

    Each side is one row already (aggregates), so their product is one.
    """
    out = scores.crossJoin(usage)
    if telemetry is None:
        return out
    named = [F.col(c).alias(k) for k, c in TELEMETRY.items()]
    return out.crossJoin(telemetry.select(*(["gpu_samples"] if "gpu_samples" in telemetry.columns else []), *named))


def majority(votes: DataFrame, sample: str, vote: str, labels: list[int]) -> DataFrame:
    """The label with most votes; null on a tie. Samples without valid votes are absent."""
    counts = votes.filter(F.col(vote).isin(labels)).groupBy(sample, vote).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(sample).orderBy(F.col("n").desc())
    top = counts.withColumn("r", F.rank().over(w)).filter("r = 1")
    return top.groupBy(sample).agg(F.when(F.count(F.lit(1)) == 1, F.min(vote)).alias("majority_vote"))


def latency(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Requests, mean and exact percentiles with linear interpolation; groups of any size (see :mod:`order_stats`)."""
    means = persist(df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.avg(value).alias("latency_mean")), "latency")
    found = percentiles(df, by, value, {f"latency_p{round(100 * q)}": q for q in (0.5, 0.9, 0.99)})
    found = found.select(*(F.col(c).alias(f"_{c}") for c in by), *found.columns[len(by):])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or F.lit(True)
    return means.join(found, same).drop(*(f"_{c}" for c in by))


def label_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("n"))
