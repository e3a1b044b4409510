"""Model calls over partitions: a bounded pool of concurrent requests per task, usage recorded for every call.

Calls have side effects, so answers are kept in a store before anything reads them, and a key that has an answer is
not asked again: neither by a later run nor by a plan that reads the result twice.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import persist
from ..ship import ensure

RESULT = (
    "response string, error string, model string, prompt_chars long, completion_chars long, total_chars long, prompt_tokens long, "
    "completion_tokens long, total_tokens long, elapsed_time_sec double"
)


@dataclass(frozen=True)
class Client:
    """An OpenAI-compatible endpoint. No call is retried; a failed one keeps its error and its time."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 300.0
    temperature: float = 0.0
    max_tokens: int = 128
    system: str | None = None
    extra: dict = field(default_factory=dict)

    def __call__(self, prompt: str, temperature: float | None = None) -> dict:
        import urllib.error
        import urllib.request

        messages = ([{"role": "system", "content": self.system}] if self.system else []) + [{"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": self.temperature if temperature is None else temperature, **self.extra}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head)
        began, text, error, usage = time.time(), None, None, {}
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                data = json.loads(answer.read())
            usage = data.get("usage") or {}
            text = (data["choices"][0]["message"]["content"] or "").strip()
        except urllib.error.HTTPError as e:
            error = f"http_{e.code}: {e.read()[:1200].decode(errors='replace')}"
        except urllib.error.URLError as e:
            error = f"connection: {e.reason}"
        except TimeoutError:
            error = "timeout"
        except json.JSONDecodeError:
            error = "invalid_json"
        except (KeyError, IndexError, TypeError):
            error = "no_choices"
        return usage_row(self.model, prompt, text, error, usage, time.time() - began)


def usage_row(model: str, prompt: str, text: str | None, error: str | None, usage: dict, seconds: float) -> dict:
    count = lambda k: int(usage[k]) if isinstance(usage.get(k), (int, float)) else None
    done = len(text or "")
    return {
        "response": text, "error": error, "model": model, "prompt_chars": len(prompt), "completion_chars": done, "total_chars": len(prompt) + done,
        "prompt_tokens": count("prompt_tokens"), "completion_tokens": count("completion_tokens"), "total_tokens": count("total_tokens"), "elapsed_time_sec": seconds,
    }


@dataclass(frozen=True)
class MockScorer:
    """Answers from a hash of the prompt: for tests and dry runs."""

    labels: tuple[int, ...] = (0, 1)
    key: str = "predicted_state"

    def __call__(self, prompt: str, temperature: float | None = None) -> dict:
        pick = self.labels[int(hashlib.sha256(prompt.encode()).hexdigest(), 16) % len(self.labels)]
        text = json.dumps({self.key: pick, "explanation": "mock"})
        usage = {"prompt_tokens": len(prompt) // 4, "completion_tokens": len(text) // 4, "total_tokens": len(prompt) // 4 + len(text) // 4}
        return usage_row("mock", prompt, text, None, usage, 0.0)


#: Calls of a task, and so what a lost executor can cost at most; and tasks of a batch.
CALLS, TASKS = 64, 512


def settings_of(call: Callable[..., dict]) -> str:
    """What of a client decides its answers, as JSON: its kind and fields, without address, key, time limit."""
    named = dataclasses.asdict(call) if dataclasses.is_dataclass(call) else {}
    kept = {k: v for k, v in named.items() if k not in ("base_url", "api_key", "timeout")}
    return json.dumps({"client": getattr(call, "__qualname__", type(call).__qualname__), **kept}, sort_keys=True, default=str)


def stored_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """What is kept at ``path``, one row per key: of several (a task that ran twice, a failure asked again) the first answer."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/*.parquet")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return None
    rows = spark.read.schema(f"key string, asked double, {RESULT}, batch string").parquet(path)
    names = [n.split()[0] for n in RESULT.split(", ")]
    first = F.struct(F.col("error").isNotNull(), F.col("asked"))  # an answer before a failure
    return rows.groupBy("key").agg(F.min_by(F.struct(*names), first).alias("a")).select("key", "a.*")


def scored(
    df: DataFrame, call: Callable[..., dict], path: str, threads: int = 8, prompt: str = "prompt", temperature: str | None = None, by: list[str] | None = None,
    calls: int = CALLS, tasks: int = TASKS,
) -> DataFrame:
    """``df`` with an answer and usage per row. Order is a column's business.

    Answers are kept at ``path`` under a key: a hash of prompt, temperature, client settings and the columns ``by``
    (``sample_id`` if there is one, by default). Only rows whose key has no answer are asked, so a run that failed
    goes on where it stopped, and a second run asks nothing. They go in batches of ``tasks`` tasks of ``calls`` rows;
    a task's answers are in place as soon as it ends, whatever becomes of its job. What a lost executor had not
    finished is asked again. Calls that failed are not kept as answers: they appear with their error, and are asked
    again by the next run. Rows with equal keys share one call.
    """
    spark = df.sparkSession
    ensure(spark)
    by = [c for c in (["sample_id"] if by is None else by) if c in df.columns]
    heat = F.col(temperature).cast("double") if temperature else F.lit(None).cast("double")
    parts = [F.col(prompt), heat.cast("string"), F.lit(settings_of(call)), *(F.col(c).cast("string") for c in by)]
    rows = persist(df.withColumn("_key", F.sha2(F.to_json(F.array(*(F.coalesce(p, F.lit("\x00")) for p in parts))), 256)), "asked")
    known, todo = stored_answers(spark, path), rows.select("_key", F.col(prompt).alias("p"), heat.alias("t")).dropDuplicates(["_key"])
    if known is not None:
        todo = todo.join(known.filter("error is null").select(F.col("key").alias("_key")), "_key", "left_anti")
    n = todo.count()
    batches = max(1, -(-n // (calls * tasks)))
    todo = persist(todo.withColumn("_batch", F.pmod(F.xxhash64("_key"), F.lit(batches))), "todo")

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {c: "Int64" for c in ("prompt_chars", "completion_chars", "total_chars", "prompt_tokens", "completion_tokens", "total_tokens")}
        with ThreadPoolExecutor(threads) as pool:
            for pdf in chunks:
                at = time.time()
                heats = [None if t is None or t != t else t for t in pdf["t"]]
                made = pd.DataFrame(list(pool.map(call, pdf["p"], heats))).astype(kinds)
                yield pd.concat([pd.DataFrame({"key": pdf["_key"].to_numpy(), "asked": at}), made], axis=1)

    failed = None
    for k in range(batches if n else 0):
        own = todo.filter(F.col("_batch") == k).repartition(max(1, min(tasks, -(-n // (calls * batches)))), "_key")
        done = own.select("_key", "p", "t").mapInPandas(run, f"key string, asked double, {RESULT}")
        # this committer puts the files of a task in place when the task ends, not when the job does
        folder = f"{path}/batch={uuid.uuid4().hex}"
        done.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
        wrong = spark.read.parquet(folder).filter("error is not null")
        failed = wrong if failed is None else failed.unionByName(wrong)
    answers = stored_answers(spark, path)
    if answers is None:
        answers = spark.createDataFrame([], f"key string, {RESULT}")
    good = answers.filter("error is null")
    if failed is not None:  # failures of this run, for rows that no run answered
        good = good.unionByName(failed.drop("asked").join(good.select("key"), "key", "left_anti"))
    return rows.join(good.withColumnRenamed("key", "_key"), "_key").drop("_key").select(*df.columns, *(n.split()[0] for n in RESULT.split(", ")))


def raise_on_failures(df: DataFrame, key: str, most: int = 10) -> None:
    """One error that names the first failures, in order of ``key``."""
    bad = df.filter(F.col("error").isNotNull())
    first = bad.orderBy(key).select(key, "error").limit(most).collect()
    if first:
        raise RuntimeError(f"{bad.count()} calls failed: " + "; ".join(f"{r[0]}: {r[1]}" for r in first))
