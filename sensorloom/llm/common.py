"""What the training-data operators share: the shared folder, row ids, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path, partition_offsets, persist, shared_dir, with_small  # noqa: F401
from ..ship import ensure

#: Word separators of every contract: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = SPACE_CLASS + "+"
WORD = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, as single texts may be very long; workers get this package.

    The values are the same for every operator: lazy plans read them when they run, in whatever order.
    """
    ensure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the JVM's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it.

    Catalyst may inline a projected column into a lambda and evaluate it per element; a lambda
    variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column) -> Column:
    """Running sums of an ``array<bigint>``, by doubling steps: n log n for n elements.

    An aggregate that appends to its own array would copy it at every step.
    """

    def add(acc: Column, by: Column) -> Column:
        more = F.transform(acc, lambda v, i: v + F.when(i >= by, F.get(acc, i - by)).otherwise(F.lit(0).cast("bigint")))
        return F.when(F.size(acc) > by, more).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(31))), x, add)


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def row_key() -> Column:
    """An id of the row, the same in every scan of a :func:`stable` table."""
    return F.monotonically_increasing_id()


_NARROW = {"Project", "Filter", "Relation", "LocalRelation"}


def stable(df: DataFrame) -> DataFrame:
    """``df`` such that each scan of it, with whatever columns, deals the same rows to the same partitions.

    Files are, and rows the plan itself holds; whatever has been shuffled, sorted, sampled or joined, comes
    from an RDD or has columns that are not deterministic is written once.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.toString().splitlines() if line.strip()}
    return df if nodes <= _NARROW and plan.deterministic() else persist(df, "pinned")


def by_key(batches: Iterator, keys: list[str]):
    """Consecutive rows with equal keys, as (key, pyarrow table), from key-sorted batches."""
    import pyarrow as pa

    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*cols))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and held_key != rows[start]:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = rows[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield held_key, pa.Table.from_batches(held)
