"""Caches of windows and texts as Parquet with a manifest, and the checks before one is used again.

A cache is ``<root>/data`` partitioned by subject and ``<root>/manifest`` (one JSON row, written last: a cache
without one is incomplete). Paths may be of any file system Spark knows. Filters on subject prune partitions,
filters on label reach the scan.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class StaleCache(RuntimeError):
    """The cache was made with other settings."""


@dataclass
class Manifest:
    dataset: str
    input_type: str = ""
    labels: list[int] = field(default_factory=list)
    loader_kwargs: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    sample_count: int = 0
    label_distribution: dict[str, int] = field(default_factory=dict)
    subjects: list[str] = field(default_factory=list)
    elapsed_time_sec: float = 0.0
    shards: list[dict] = field(default_factory=list)

    def loader_settings(self) -> dict:
        """Settings of the first layer that states them: the source, the source's subset, this cache."""
        for layer in (self.source.get("source_processed") or {}, (self.source.get("subset") or {}).get("source_processed") or {}):
            if layer.get("loader_kwargs"):
                return layer["loader_kwargs"]
        return self.loader_kwargs


def save(df: DataFrame, root: str, manifest: Manifest, overwrite: bool = False) -> Manifest:
    """Write samples (``subject``, ``label``, …) and then the manifest with their counts."""
    began = time.time()
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("subject").parquet(f"{root}/data")
    stored = df.sparkSession.read.parquet(f"{root}/data")
    counts = stored.groupBy("label").count().orderBy("label").collect()
    manifest.label_distribution = {str(r[0]): r[1] for r in counts}
    manifest.sample_count = sum(manifest.label_distribution.values())
    manifest.subjects = [r[0] for r in stored.select(F.col("subject").cast("string")).distinct().orderBy("subject").collect()]
    manifest.elapsed_time_sec = time.time() - began
    _write_manifest(df.sparkSession, root, manifest)
    return manifest


#: A shard's entry in the journal; the last one of a subject counts.
JOURNAL = "subject string, settings string, state string, samples long, labels map<string,long>, digest string, elapsed_time_sec double, at double"
#: Subjects of one job.
GROUP = 64


def settings_key(manifest: Manifest) -> str:
    """A hash of what a shard was made with."""
    made = [manifest.dataset, manifest.input_type, manifest.labels, manifest.loader_kwargs]
    return hashlib.sha256(json.dumps(made, sort_keys=True, default=str).encode()).hexdigest()


def journal(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of each subject in a cache's journal."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/journal")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], JOURNAL)
    rows = spark.read.schema(JOURNAL).parquet(f"{root}/journal")
    return rows.groupBy("subject").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "subject")), "at").alias("e")).select("subject", "e.*")


def shard_digests(df: DataFrame) -> DataFrame:
    """Per subject ``samples``, ``labels`` (counts) and a ``digest`` of the rows' contents, whatever their order."""
    names = sorted(c for c in df.columns if c != "subject")
    row = F.sha2(F.to_json(F.struct(*names)), 256)
    number = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    each = df.select(F.col("subject").cast("string").alias("subject"), F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("l"), number(1).alias("a"), number(16).alias("b"))
    each = each.groupBy("subject", "l").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.groupBy("subject").agg(
        F.sum("n").alias("samples"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("labels"),
        F.sha2(F.concat_ws(":", F.sum("n"), F.sum("a"), F.sum("b")), 256).alias("digest"),
    )


def build(spark: SparkSession, root: str, manifest: Manifest, subjects: list[str], make: Callable[[list[str]], DataFrame], overwrite: bool = False, group: int = GROUP) -> Manifest:
    """A cache made shard by shard (a shard is a subject), ``group`` subjects a job; a build that stopped goes on.

    ``make`` plans the samples of some subjects. A journal beside the data has an entry for each finished shard: its
    settings, counts, digest and time. Subjects without an entry of the present settings are made, the others
    stay; ``overwrite`` makes all. Data come first and the entry after, and data replace what the subject had, so a
    job that died between the two is done again. The manifest is written when no subject is left.
    """
    if not subjects:
        raise ValueError("no subjects to build")
    settings = settings_key(manifest)
    done = {r["subject"] for r in journal(spark, root).filter((F.col("settings") == settings) & (F.col("state") == "done")).select("subject").collect()}
    left = [s for s in dict.fromkeys(map(str, subjects)) if overwrite or s not in done]
    for i in range(0, len(left), group):
        part, began = left[i : i + group], time.time()
        _drop_shards(spark, root, part)
        rows = make(part)
        rows.filter(F.col("subject").cast("string").isin(part)).write.mode("append").partitionBy("subject").parquet(f"{root}/data")
        wanted = spark.createDataFrame([(s,) for s in part], "subject string")
        made = shard_digests(_shards(spark, root, rows.schema).filter(F.col("subject").isin(part)))
        entries = wanted.join(made, "subject", "left").select(
            "subject", F.lit(settings).alias("settings"), F.lit("done").alias("state"), F.coalesce("samples", F.lit(0)).alias("samples"), "labels", "digest",
            F.lit(time.time() - began).alias("elapsed_time_sec"), F.lit(time.time()).alias("at"),
        )
        entries.coalesce(1).write.mode("append").parquet(f"{root}/journal")
    entries = journal(spark, root).filter((F.col("settings") == settings) & F.col("subject").isin(list(map(str, subjects))))
    shards = [r.asDict() for r in entries.orderBy("subject").drop("settings", "state", "at").collect()]
    counts: dict[str, int] = {}
    for s in shards:
        for label, n in (s["labels"] or {}).items():
            counts[label] = counts.get(label, 0) + n
    manifest.label_distribution = dict(sorted(counts.items()))
    manifest.sample_count = sum(s["samples"] for s in shards)
    manifest.subjects = [s["subject"] for s in shards if s["samples"]]
    manifest.elapsed_time_sec = sum(s["elapsed_time_sec"] for s in shards)
    manifest.shards = shards
    _write_manifest(spark, root, manifest)
    return manifest


def _shards(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    fields = [StructField(f.name, StringType() if f.name == "subject" else f.dataType) for f in schema]
    return spark.read.schema(StructType(fields)).parquet(f"{root}/data")


def _drop_shards(spark: SparkSession, root: str, subjects: list[str]) -> None:
    """Remove what a build that stopped, or one with other settings, left of these subjects."""
    jvm = spark._jvm
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for s in subjects:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/data/subject={escape(s)}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write_manifest(spark: SparkSession, root: str, manifest: Manifest) -> None:
    row = [(json.dumps(manifest.__dict__, ensure_ascii=False),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def load_manifest(spark: SparkSession, root: str) -> Manifest:
    return Manifest(**json.loads(spark.read.text(f"{root}/manifest").first()[0]))


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(float(a), float(b), rel_tol=0, abs_tol=1e-9)
    return a == b


def validate(manifest: Manifest, dataset: str, input_type: str | None, settings: dict) -> None:
    """Raise if the cache is of another dataset or input (ValueError) or of other settings (StaleCache)."""
    if manifest.dataset != dataset:
        raise ValueError(f"cache holds dataset {manifest.dataset!r}, not {dataset!r}")
    if input_type and manifest.input_type and manifest.input_type != input_type:
        raise ValueError(f"cache holds input {manifest.input_type!r}, not {input_type!r}")
    made = manifest.loader_settings()
    wrong = {k: (made.get(k), v) for k, v in settings.items() if not _same(made.get(k), v)}
    if wrong:
        raise StaleCache("cache was made with other settings: " + ", ".join(f"{k} {a!r} instead of {b!r}" for k, (a, b) in sorted(wrong.items())))


def load(spark: SparkSession, root: str, subjects: list[str] | None = None, labels: list[int] | None = None) -> DataFrame:
    """Samples of a cache; an empty list of subjects is no filter."""
    df = spark.read.parquet(f"{root}/data")
    if subjects:
        df = df.filter(F.col("subject").cast("string").isin([str(s) for s in subjects]))
    return df.filter(F.col("label").isin(labels)) if labels else df


def write_predictions_csv(df: DataFrame, path: str) -> None:
    """One local UTF-8 file with byte-order mark, streamed row by row from the partitions."""
    import csv
    import os

    with open(path + ".tmp", "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
    os.replace(path + ".tmp", path)


def write_json(value: dict, path: str) -> None:
    import os

    with open(path + ".tmp", "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2, default=str)
    os.replace(path + ".tmp", path)


def append_traces(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
