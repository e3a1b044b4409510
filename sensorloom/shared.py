"""The folder all machines share, tables written there to end lineage, and numbering by ranges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session does not name one, a local folder is set on a single machine (``local`` masters: tests,
    benchmarks); a cluster without one is an error, as its machines do not see each other's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master!r} is no single machine")
        path = "file://" + tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder, removed when the application ends."""
    name = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def persist(df: DataFrame, tag: str, compression: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there.

    Lost executors then cost the later stages nothing that was written before. ``by``: columns whose values get
    folders of their own, so that filters on them leave the others unread.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=compression, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.select(*(f"`{c}`" for c in df.columns)) if by else out  # such columns come last


def partition_offsets(totals: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, first)``: the sum of ``value`` over all smaller keys.

    ``totals`` has one row per partition of a job, so it is counted in partitions, not rows.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("first"))


def with_small(
    df: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", most: int = 200_000, weight: Column | None = None
) -> DataFrame:
    """Join with a table that was just written; broadcast it only when its count allows.

    ``weight``: what a row counts, such as the length of its list; 1 by default. Beyond ``most`` both sides are
    shuffled (and hot keys split by Spark).
    """
    if weight is None:
        size = small.limit(most + 1).count()
    else:
        size = small.agg(F.sum(weight)).first()[0] or 0
    return df.join(F.broadcast(small) if size <= most else small, on, how)
