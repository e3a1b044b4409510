"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of the source. Its
whole part is taken at once; the fractions are rounded dependently: the longest document and all shorter
ones of its group, which still share one fraction, exchange expected words, in a random direction that
keeps all expectations, until either side is settled (0 or 1 copy more); then the next. The words of the
source are thereby kept exactly, and what remains of a group is one document, the shortest unless a single
one outweighs what the others can give. Documents of unequal fractions are paired two by two.

A source of more than ``LEAF`` documents is dealt to leaves of about that many by a hash of the document;
the remainders of its leaves meet in groups of ``LEAF``, level by level, up to one document, which is
drawn. Smaller sources are settled whole, several in a group. Randomness comes from hashes of the
documents, so reruns agree, whatever the partitions and executors; only rows that repeat one id and one
text more than ``REPEATS`` times are dealt by their place in the files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partition_offsets, persist, row_key, small_batches, stable, with_small, word_count

LEAF, REPEATS = 1024, 128
WEIGHTS = (5, 2, 1)
PERCENT, MOST = 150, 2
_GONE = (1 << 64) - 1


def _unit(*keys: int) -> float:
    """A number in [0, 1) from integers."""
    x = 0x9E3779B97F4A7C15
    for k in keys:
        x = (x ^ (k & _GONE)) * 0xBF58476D1CE4E5B9 & _GONE
        x ^= x >> 31
        x = x * 0x94D049BB133111EB & _GONE
        x ^= x >> 29
    return (x >> 11) / (1 << 53)


def settle(shares: list[float], sizes: list[int], marks: list[int], seed: int = 0) -> list[float]:
    """Pivotal rounding of one source's shares: all but at most one end as 0.0 or 1.0.

    ``sum(share * size)`` stays what it was, and so does the expectation of each share.
    """
    out, open_ = list(shares), -1
    for j, (p, s) in enumerate(zip(shares, sizes)):
        if s == 0 or p <= 0.0 or p >= 1.0:
            out[j] = 1.0 if p >= 1.0 else 0.0
            continue
        if open_ < 0:
            open_ = j
            continue
        i = open_
        a, b, si = out[i], p, sizes[i]
        to_j, to_i = min(a * si, (1 - b) * s), min((1 - a) * si, b * s)
        if _unit(seed, marks[i], marks[j]) * (to_j + to_i) < to_i:
            if a * si <= (1 - b) * s:
                out[i], out[j] = 0.0, b + to_j / s
            else:
                out[i], out[j] = a - to_j / si, 1.0
        elif (1 - a) * si <= b * s:
            out[i], out[j] = 1.0, b - to_i / s
        else:
            out[i], out[j] = a + to_i / si, 0.0
        open_ = next((k for k in (i, j) if 1e-12 < out[k] < 1 - 1e-12), -1)
        for k in (i, j):
            if k != open_:
                out[k] = float(round(out[k]))
    return out


def settle_equal(share: float, sizes: list[int], marks: list[int], seed: int = 0) -> list[float]:
    """Pivotal rounding of one share that all documents have: all but at most one end as 0.0 or 1.0.

    ``sizes`` descend. Each document is paired with all after it, taken as one: these gain or lose alike, so
    each keeps its expectation, and the words of all stay what they were.
    """
    out, rest, b = [0.0] * len(sizes), sum(sizes), share
    for i, s in enumerate(sizes):
        rest -= s
        if b <= 1e-12 or b >= 1 - 1e-12:
            out[i:] = [float(round(b))] * (len(sizes) - i)
            break
        if not rest:
            out[i] = b if s else 0.0
            break
        up, down = min((1 - b) * s, b * rest), min(b * s, (1 - b) * rest)
        gains = _unit(seed, marks[i]) * (up + down) < down
        if s * ((1 - b) if gains else b) <= rest * (b if gains else 1 - b):
            out[i], b = float(gains), b - up / rest if gains else b + down / rest
        else:  # the others are settled first, this one stays open
            out[i] = b + up / s if gains else b - down / s
            out[i + 1 :] = [0.0 if gains else 1.0] * (len(sizes) - i - 1)
            break
    return out


def _by_code_point(sources: DataFrame) -> DataFrame:
    """``place``: how many sources come before, by code point, null last; without one task for all."""
    order = F.col("source").asc_nulls_last()
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = sources.repartitionByRange(order).sortWithinPartitions(order)
    dealt = persist(dealt.select("*", F.spark_partition_id().alias("part"), local.alias("local")), "sources")
    offsets = partition_offsets(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "part", "rows")
    return dealt.join(offsets, "part").withColumn("place", F.col("first") + F.col("local")).drop("part", "local", "first")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: shares by weight, capped, the excess reshared.

    Each round is one aggregate over sources; only sums reach the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    ranked = persist(_by_code_point(sizes).withColumn("weight", weight), "weights")
    cap = (F.col("source_size") * most).cast("double")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level if capped >= 0 else F.lit(False)
        n, words, rest = ranked.agg(
            F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == capped or not rest:
            break
        level, capped = (total - words) / rest, n
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level)).drop("place", "weight")


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", leaf: int = LEAF) -> DataFrame:
    """One row per row of ``df``: its id, ``size``, ``source_size``, ``target``, ``taken``, ``copies``, ``_row``.

    Null texts have no words and are taken zero times more than their source's whole copies; a null
    source is a source. Null or repeated ids are rows like others. An empty table gives an empty result.
    """
    df = stable(df)
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = persist(
        df.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
            F.xxhash64(F.col(id_col), text).alias("mark"), row_key().alias("row"),
        ), "sizes",
    )
    sums = persist(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sums")
    goals = targets(sums)
    goals = persist(goals.select(_source_key(F.col("source")).alias("key"), "source_size", "docs", "target"), "targets")
    total = sums.agg(F.sum("docs")).first()[0] or 0
    repeated = persist(rows.groupBy("mark").count().filter(F.col("count") > REPEATS).select("mark", F.lit(True).alias("often")), "repeated")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = with_small(rows.withColumn("key", _source_key(F.col("source"))).drop("source"), goals, "key")
    shared = with_small(shared, repeated, "mark", "left").withColumn("spot", F.when(F.col("often"), F.col("row"))).drop("often")
    shared = shared.withColumn("whole", F.floor(rate)).withColumn("share", rate - F.col("whole"))
    # a source of several leaves has groups of its own, the others share them
    shared = shared.withColumn("leaves", F.ceil(F.col("docs") / leaf)).drop("docs")
    several = F.pmod(F.xxhash64("mark", "spot", F.lit(7)), "leaves")
    shared = shared.withColumn("group", F.when(F.col("leaves") > 1, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(total / leaf))))))
    shared = shared.withColumn("leaf", F.when(F.col("leaves") > 1, several).otherwise(F.lit(-1).cast("long"))).drop("spot")
    schema = shared.schema

    def pivot(seed: int):
        def run(pdf):
            pdf = pdf.sort_values(["key", "size", "mark"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
            share = pdf["share"].to_numpy(copy=True)
            marks, sizes, leaves = (pdf[c].to_numpy() for c in ("mark", "size", "leaves"))
            for at in pdf.groupby("key", sort=False).indices.values():
                m, s = marks[at].tolist(), sizes[at].tolist()
                got = settle(share[at].tolist(), s, m, seed) if seed else settle_equal(float(share[at[0]]), s, m)
                if leaves[at[0]] == 1:
                    got = [g if g in (0.0, 1.0) else float(_unit(seed, x) < g) for g, x in zip(got, m)]
                share[at] = got
            return pdf.assign(share=share)

        return run

    done, now, level = [], shared, 0
    most = goals.agg(F.max(F.ceil(F.col("docs") / leaf))).first()[0] or 1
    while True:
        now = persist(now.groupBy("group", "leaf").applyInPandas(pivot(level), schema), f"level{level}")
        unsettled = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(now.filter(~unsettled))
        if most == 1:
            break
        most, level = math.ceil(most / leaf), level + 1
        now = now.filter(unsettled).withColumns({"leaf": F.floor(F.col("leaf") / leaf), "leaves": F.ceil(F.col("leaves") / leaf)})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("share")).cast("long")
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
        copies.alias("copies"), F.col("row").alias("_row"),
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all their columns."""
    df = stable(df)
    chosen = mix(df, id_col, text_col, source_col).filter("copies <> 1").select(F.col("_row").alias("_this_row"), F.col("copies").alias("_copies"))
    rows = df.select(F.struct("*").alias("_all")).withColumn("_this_row", row_key())
    copies = F.coalesce("_copies", F.lit(1)).cast("int")
    out = with_small(rows, persist(chosen, "chosen"), "_this_row", "left").withColumn("_copies", copies)
    return out.select("_all", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select("_all.*")
