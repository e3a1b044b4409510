"""Exact deduplication by skew-safe combining, full content compared at every stage.

1. *Local*: the map side of the first aggregation keeps one row per distinct text of a task,
   so a text that holds a third of all rows leaves each task once.
2. *Salted*: those rows meet by (digest, salt, content); the salt comes from the task, so the
   survivors of a hot text are spread over ``salts`` reducers.
3. *Global*: the salt winners, at most ``salts`` a text, meet by (digest, content).

The key of each aggregation holds the whole normalised text, so texts whose digests are equal
but whose contents differ stay apart. The rows then find their group by digest alone: a narrow
join that never moves a text and whose hot side Spark splits. If two groups share a digest
(seen by counting), that join compares content as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, persist, row_key, stable, with_small

SALTS = 32
_SHIFT = "10000000000000000000"


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _rank(doc_id: Column, row: Column) -> Column:
    """A number that orders rows by (doc_id, row), null ids first."""
    big = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit("-9300000000000000000").cast("decimal(19,0)"))
    return (big * F.lit(_SHIFT).cast("decimal(20,0)") + row.cast("decimal(19,0)")).cast("decimal(38,0)")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``_row``.

    Null texts count as empty. Of equal texts the row with the largest id stays; among rows that
    repeat that id exactly one does, and a null id is smaller than any other. An empty table gives
    an empty result. Other columns of ``df`` are not read, whatever their names.
    """
    df = stable(df)
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", row_key())
    rows = base.select(
        "_id", "_row", normalised(F.col("_text")).alias("_norm"), (F.spark_partition_id() % salts).alias("_salt")
    ).withColumn("_digest", F.unhex(F.sha2("_norm", 256)))

    best = rows.withColumn("_rank", _rank(F.col("_id"), F.col("_row")))
    salted = best.groupBy("_digest", "_salt", "_norm").agg(
        F.max("_rank").alias("_rank"), F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")
    )
    merged = salted.groupBy("_digest", "_norm").agg(
        F.max("_rank").alias("_rank"), F.max("_keep").alias("_keep"), F.sum("_n").alias("_n")
    )
    # the content of a group is needed again only where digests collide
    groups = persist(merged.select("_digest", F.xxhash64("_norm").alias("_check"), "_rank", "_keep", "_n"), "exact-groups")
    total, digests = groups.agg(F.count(F.lit(1)), F.count_distinct("_digest")).first()
    narrow = rows.select("_id", "_row", "_digest", F.xxhash64("_norm").alias("_check"))
    on = ["_digest"] if total == digests else ["_digest", "_check"]
    if total != digests and total != groups.select(*on).distinct().count():
        groups, narrow, on = merged, rows.select("_id", "_row", "_digest", "_norm"), ["_digest", "_norm"]
    out = narrow.drop("_check").join(groups.drop("_check"), on) if on == ["_digest"] else narrow.join(groups, on)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_rank") == _rank(F.col("_id"), F.col("_row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_row",
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever these are called."""
    df = stable(df)
    gone = exact_groups(df, id_col, text_col).filter("not kept").select(F.col("_row").alias("_this_row"))
    rows = df.select(F.struct("*").alias("_all")).withColumn("_this_row", row_key())
    return with_small(rows, persist(gone, "gone"), "_this_row", "left_anti").select("_all.*")
