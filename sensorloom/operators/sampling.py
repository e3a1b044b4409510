"""Reproducible samples, splits and few-shot pools: every choice is an order of SHA-256 hashes.

Windows are partitioned by label, subject or both, and always end on a unique column, so results do not
depend on partitions or reruns. Subject-level tables are small next to the samples; they are aggregated first
and joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import natural_key, stable_hash
from ..shared import partition_offsets, persist, with_small

#: Subjects of a block of the leave-one-out pool, and lists merged at a time.
BLOCK = 1024


class Shortage(ValueError):
    """A group has fewer rows than asked for."""


def ranked(df: DataFrame, by: list[str], order: Column, tie: str, out: str = "rn") -> DataFrame:
    """``out``: the place of each row in its group, from 1. Without groups, of all rows, by range and not in one task."""
    if not by:
        return placed(df, [order, F.col(tie)], out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def placed(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``out``: the place of each row in the order of the whole table, from 1.

    Rows are dealt by ranges of the order, numbered in each range, and ranges get their start from the sizes
    of those before: no task sees all rows. Ranges are written, so numbers and sizes are of the same ones.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = persist(dealt.select("*", F.spark_partition_id().alias("_part"), local.alias("_local")), "ranges")
    first = partition_offsets(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")), "_part", "_rows")
    return dealt.join(first, "_part").withColumn(out, F.col("first") + F.col("_local") + 1).drop("_part", "_local", "first")


def top_per_group(df: DataFrame, by: list[str], n: int, seed: int, tag: str, key: str) -> DataFrame:
    """The first ``n`` rows of each group by hash of (seed, tag, group, key)."""
    order = stable_hash(seed, tag, *(F.col(c) for c in by), F.col(key))
    if not by:
        return df.orderBy(order, key).limit(n)
    return ranked(df, by, order, key).filter(F.col("rn") <= n).drop("rn")


def label_balanced(df: DataFrame, label: str, n: int, seed: int, key: str, allow_shortage: bool = False) -> DataFrame:
    """``n`` rows of each label; too few is an error, or lowers ``n`` for all if allowed."""
    counts = df.groupBy(label).count()
    least = counts.agg(F.min("count")).first()[0] or 0
    if least < n:
        if not allow_shortage:
            short = [f"{r[0]}: {r[1]}" for r in counts.filter(F.col("count") < n).orderBy(label).limit(20).collect()]
            raise Shortage(f"fewer than {n} rows for labels {', '.join(short)}")
        n = least
    return top_per_group(df, [label], n, seed, "label-balanced", key)


def per_subject_cap(df: DataFrame, subject: str, n: int, seed: int, key: str) -> DataFrame:
    return ranked(df, [subject], stable_hash(seed, "per-subject-limit", F.col(key)), key).filter(F.col("rn") <= n).drop("rn")


def balanced_limit(df: DataFrame, label: str, subject: str, key: str, per_label: int | None, per_subject: int | None, limit: int | None, seed: int = 42) -> DataFrame:
    """Balance by label, then cap by subject in a new hash order, then cut: the three steps in this order."""
    if per_label is not None:
        df = top_per_group(df, [label], per_label, seed, "balanced-per-label", key)
    order = [F.col(label), stable_hash(seed, "balanced-per-label", F.col(label), F.col(key)), F.col(key)]
    if per_subject is not None:
        df = per_subject_cap(df, subject, per_subject, seed, key)
        order = [stable_hash(seed, "per-subject-limit", F.col(key)), F.col(key)]
    return df.orderBy(*order).limit(limit) if limit is not None else df


def complete_subjects(df: DataFrame, subject: str, label: str, labels: list[int], least: int = 1) -> DataFrame:
    """Subjects with ``least`` rows or more of every label."""
    each = [F.count_if(F.col(label) == v) >= least for v in labels]
    return df.groupBy(subject).agg(*(c.alias(f"_{i}") for i, c in enumerate(each))).filter(" and ".join(f"_{i}" for i in range(len(each)))).select(subject)


def selected_subjects(df: DataFrame, subject: str, label: str, labels: list[int], least: int, k: int, seed: int) -> DataFrame:
    """``k`` complete subjects by hash, in natural order of their names."""
    good = complete_subjects(df, subject, label, labels, least)
    picked = good.orderBy(stable_hash(seed, "subject", F.col(subject)), subject).limit(k)
    return picked.orderBy(natural_key(F.col(subject).cast("string")), subject)


def subject_label_balanced(df: DataFrame, subject: str, label: str, n: int, seed: int, key: str) -> DataFrame:
    return top_per_group(df, [subject, label], n, seed, "subject-label-balanced", key)


def other_subjects(subjects: DataFrame, pool: DataFrame, subject: str, k: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Leave one out: ``eval_subject, subject, subject_rank`` of the ``k`` pool subjects by hash for each.

    ``subjects`` and ``pool`` are distinct lists of subjects; nulls are passed by. The hash is of the pair, so each
    subject meets the pool, in blocks of about ``block``: a row holds a block, ranks it and keeps ``k``. The best of
    the blocks meet in rounds of ``block`` lists, so no list grows with the pool, and no pair leaves its row.
    """
    pool = pool.select(F.col(subject).alias("_s")).filter("_s is not null")
    n = max(1, -(-pool.count() // block))
    blocks = pool.groupBy(F.pmod(F.xxhash64("_s"), F.lit(n)).alias("_block")).agg(F.collect_list("_s").alias("_pool"))
    blocks = persist(blocks, "pool-blocks")
    left = subjects.select(F.col(subject).alias("eval_subject")).filter("eval_subject is not null")
    met = with_small(left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))), blocks, "_block", weight=F.size("_pool"))
    least = lambda pairs: F.slice(F.array_sort(pairs), 1, k)
    hashed = lambda s: F.struct(stable_hash(seed, "few-shot-subject", F.col("eval_subject"), s).alias("h"), s.alias("s"))
    best = met.select("eval_subject", "_block", least(F.transform(F.filter("_pool", lambda s: s != F.col("eval_subject")), hashed)).alias("_best"))
    while True:
        n = -(-n // block)
        best = best.groupBy("eval_subject", F.floor(F.col("_block") / block).alias("_block")).agg(least(F.flatten(F.collect_list("_best"))).alias("_best"))
        if n == 1:
            break
    out = best.select("eval_subject", F.posexplode("_best").alias("_at", "_b"))
    return out.select("eval_subject", F.col("_b.s").alias(subject), (F.col("_at") + 1).alias("subject_rank"))


def examples(candidates: DataFrame, samples: DataFrame, subject: str, label: str, key: str, n: int, seed: int) -> DataFrame:
    """Few-shot examples of each evaluated subject: per candidate and label the first ``n`` by hash, ``rn`` from 1."""
    order = stable_hash(seed, "few-shot-sample", F.col(subject), F.col(label), F.col(key))
    picked = ranked(samples.select(subject, label, key), [subject, label], order, key).filter(F.col("rn") <= n)
    return candidates.join(picked, subject)


def digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the sorted row keys, ``digest, rows``.

    Row keys are hashed, the hashes joined in order by a prefix of three digits, and the digests of the prefixes
    joined again. From 16 million rows on a longer prefix comes first, a digit more for every factor of 16, so no
    list grows with the table.
    """
    row = F.sha2(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)), 256).alias("h")
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["h"]), ","), 256)
    depth, n = 3, df.count()
    while n > 16 ** (3 + depth):
        depth += 1
    parts = df.select(row).select(F.substring("h", 1, depth).alias("p"), F.struct("h").alias("s"))
    parts = parts.groupBy("p").agg(joined("s").alias("h"), F.count(F.lit(1)).alias("n"))
    for k in range(depth - 1, 2, -1):
        parts = parts.groupBy(F.substring("p", 1, k).alias("p")).agg(joined(F.struct("p", "h")).alias("h"), F.sum("n").alias("n"))
    return parts.agg(joined(F.struct("p", "h")).alias("digest"), F.sum("n").alias("rows"))


def assert_balanced(df: DataFrame, label: str, labels: list[int], n: int) -> None:
    """Raise unless every label has exactly ``n`` rows; names shortages and excesses."""
    found = {r[0]: r[1] for r in df.filter(F.col(label).isin(labels)).groupBy(label).count().collect()}
    wrong = {v: found.get(v, 0) for v in labels if found.get(v, 0) != n}
    if wrong:
        short = {k: v for k, v in wrong.items() if v < n}
        more = {k: v for k, v in wrong.items() if v > n}
        raise Shortage(f"expected {n} rows a label; shortage: {short}; excess: {more}")


def check_disjoint(train: list[str], test: list[str]) -> None:
    both = sorted(set(map(str, train)) & set(map(str, test)))
    if both:
        raise ValueError(f"subjects in train and test: {', '.join(both)}")


def split_subjects(subjects: list[str], train: list[str] | None = None, test: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Train and test lists; a missing one is the complement, in order; with neither the first subject trains."""
    clean = [s for s in (str(x).strip() for x in subjects) if s]
    if train and test:
        check_disjoint(train, test)
        return list(train), list(test)
    if train:
        return list(train), [s for s in clean if s not in set(train)]
    if test:
        return [s for s in clean if s not in set(test)], list(test)
    if len(clean) < 2:
        raise ValueError("a split needs two subjects")
    return clean[:1], clean[1:]
