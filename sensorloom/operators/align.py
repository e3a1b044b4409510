"""Alignment of representations of the same samples: keyed, then by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of metadata that can identify a sample, in order of preference.
KEY_GROUPS = (
    ("sample_id",), ("local_index",), ("data_index",), ("epoch_id",), ("window_id",), ("start_index", "end_index"),
    ("window_start", "window_end"), ("window_start_sec", "window_end_sec"),
)


def alignment_key(columns: list[str]) -> Column:
    """Group name, dataset, subject, label and the values of the first complete group; null without one."""
    have = set(columns)
    options = []
    for group in KEY_GROUPS:
        if not have.issuperset(group):
            continue
        values = [F.col(c).cast("string") for c in group]
        full = F.lit(True)
        for v in values:
            full = full & v.isNotNull() & (v != "")
        head = [F.lit("+".join(group)), F.col("dataset"), F.col("subject").cast("string"), F.col("label").cast("string")]
        options.append(F.when(full, F.to_json(F.array(*head, *values))))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def with_views(base: DataFrame, views: dict[str, DataFrame], position: str = "position") -> DataFrame:
    """``base`` with ``input_views``, a map of view name to text, and ``missing_views``.

    A view's row is found by key (its first row of a key counts), else at the same position if dataset, subject
    and label agree.
    """
    out = base.withColumn("_key", alignment_key(base.columns))
    entries = []
    for i, (name, df) in enumerate(views.items()):
        keyed = df.withColumn("_key", alignment_key(df.columns)).filter("_key is not null")
        w = Window.partitionBy("_key").orderBy(position)
        first = keyed.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("_key", F.col("input_text").alias(f"_k{i}"))
        same = ["dataset", "subject", "label", position]
        placed = df.select(*same, F.col("input_text").alias(f"_p{i}"))
        out = out.join(first, "_key", "left").join(placed, same, "left")
        entries.append((name, F.coalesce(f"_k{i}", f"_p{i}")))
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in entries))
    held = F.filter(pairs, lambda x: x["value"].isNotNull())
    missing = F.transform(F.filter(pairs, lambda x: x["value"].isNull()), lambda x: x["key"])
    drop = [f"_{c}{i}" for i in range(len(views)) for c in "kp"]
    return out.withColumns({"input_views": F.map_from_entries(held), "missing_views": missing}).drop("_key", *drop)
