"""Exact percentiles of any number of rows by range refinement.

An exact percentile needs at most two rows of the sorted group. Instead of sorting the group, or merging a map of
its distinct values in one task, each pass counts rows in equal cells of a range, and only the cell that holds a
wanted rank becomes the next range, shrunk to the values in it. What a pass keeps is one row per cell and range.
A range with few rows, or of one value, ends the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import persist, with_small

#: Cells of a range, and rows from which on a range is refined instead of sorted.
CELLS, FEW = 1024, 4096


def _cell(v: Column, lo: Column, hi: Column, spread: bool, cells: int) -> Column:
    """The cell of ``v`` in [lo, hi], growing with ``v``; ``lo`` lies in the first and ``hi`` in the last.

    ``spread``: cells are even in orders of magnitude around 0 instead of in the values, for rows that crowd
    in a small part of the range.
    """
    at = (lambda x: F.signum(x) * F.log1p(F.abs(x) * 1e12)) if spread else (lambda x: x / 2)
    share = (at(v) - at(lo)) / (at(hi) - at(lo))
    inner = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * cells).cast("int")))
    return F.when(v <= lo, 0).when(v >= hi, cells - 1).otherwise(inner)


def percentiles(df: DataFrame, by: list[str], value: str, fractions: dict[str, float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """Per group the percentile at each of ``fractions`` (named by the keys), linear between the two nearest rows.

    Nulls and NaN do not count; a group without other values has null percentiles. Equal to Spark's
    ``percentile`` on finite values.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    base = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).cast("double").alias("_v"))
    base = base.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v"))).withColumn("_g", F.struct(F.lit(0), *keys))  # structs of nulls are equal
    groups = persist(base.groupBy("_g").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    rows = base.select("_g", "_v").filter("_v is not null")

    # the ranks wanted of each group: the one below a fraction's place and the one above
    spot = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(spot(q)), F.ceil(spot(q))) for q in fractions.values()))))
    open_ = groups.filter("_n > 0").select("_g", F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), "_n")
    found, turn = None, 0
    while True:
        open_ = persist(open_, f"ranges{turn}")
        done = open_.filter("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_v"))
        last = open_.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") <= few))
        ranges = last.select("_g", "_lo", "_hi", "_below").distinct()
        here = with_small(rows, ranges, "_g").filter("_v between _lo and _hi")
        w = Window.partitionBy("_g", "_lo", "_hi").orderBy("_v")
        here = here.withColumn("_rank", F.col("_below") + F.row_number().over(w) - 1).select("_g", "_rank", "_v")
        done = done.unionByName(here.join(last.select("_g", "_rank"), ["_g", "_rank"]))
        found = done if found is None else found.unionByName(done)
        more = open_.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > few))
        if not more.limit(1).count():
            break
        ranges = more.select("_g", "_lo", "_hi", "_below").distinct()
        met = with_small(rows, ranges, "_g").filter("_v between _lo and _hi")
        cell = _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), turn % 2 == 1, cells).alias("_cell")
        counts = met.groupBy("_g", "_lo", "_hi", "_below", cell).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        counts = persist(counts, f"cells{turn}")
        w = Window.partitionBy("_g", "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
        first = F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0))
        counts = counts.select("_g", "_lo", "_hi", "_least", "_most", "_c", first.alias("_first"))
        open_ = more.drop("_below", "_n").join(counts, ["_g", "_lo", "_hi"]).filter("_rank >= _first and _rank < _first + _c")
        open_ = open_.select("_g", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_first").alias("_below"), F.col("_c").alias("_n"))
        turn += 1
    at = persist(found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")), "ranks")
    out = groups.join(at, "_g", "left")

    def value_at(q: float) -> Column:
        low, high = F.floor(spot(q)), F.ceil(spot(q))
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        return F.when(low == high, a).otherwise((high - spot(q)) * a + (spot(q) - low) * b)

    return out.select(*(F.col(f"_g.{k}").alias(c) for c, k in zip(by, keys)), *(value_at(q).alias(name) for name, q in fractions.items()))
