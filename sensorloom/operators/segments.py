"""Segments and windows of long-form recordings.

All operators are keyed by the recording (subject, device, ...): one shuffle on the key serves segmentation,
and window assignment is an explode of integer slots, so no range join and no nested loop is planned. A
slot is an integer multiple of the stride, never a sum of floats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import persist, with_small


#: Seconds of a chunk of a recording, in gaps: chunks are the unit of work, so one long recording is many tasks.
CHUNK = 1 << 14


def gap_segments(df: DataFrame, by: list[str], time: str, gap: float, out: str = "segment_id") -> DataFrame:
    """``out``: segments from 0 in order of time; a step longer than ``gap`` begins a new one. Null times go.

    Breaks are counted inside chunks of time; what chunks begin with comes from a table of one row a chunk.
    """
    rows = df.filter(F.col(time).isNotNull()).withColumn("_chunk", F.floor(F.col(time) / (gap * CHUNK)))
    w = Window.partitionBy(*by, "_chunk").orderBy(time)
    step = F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0))
    rows = rows.withColumn("_breaks", F.sum((step > gap).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = rows.groupBy(*by, "_chunk").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.max("_breaks").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_chunk")
    new = F.coalesce((F.col("_lo") - F.lag("_hi").over(order) > gap).cast("bigint"), F.lit(0).cast("bigint"))
    total = F.sum(F.col("_new") + F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = chunks.withColumn("_new", new).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_chunk"])), (total - F.col("_n")).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_chunk"])]
    return rows.join(first, same).select(*df.columns, (F.col("_first") + F.col("_breaks")).alias(out))


def numbered(df: DataFrame, by: list[str], time: str, tie: str, out: str, width: float) -> DataFrame:
    """``out``: the place of each row in its group by (``time``, ``tie``), from 0. Null times go.

    Rows are numbered inside chunks of ``width``; chunks start where those before end, from a table of one row
    a chunk.
    """
    rows = df.filter(F.col(time).isNotNull()).withColumn("_chunk", F.floor(F.col(time) / width))
    sizes = rows.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "_chunk"]
    first = persist(sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("_first")), "chunks")
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(time, tie)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return with_small(rows.withColumn("_local", local), first, same).select(*df.columns, (F.col("_first") + F.col("_local")).alias(out))


#: Index units of a chunk of labelled rows.
ROWS = 1 << 16


def label_islands(df: DataFrame, by: list[str], index: str, label: str, rows: int = ROWS) -> DataFrame:
    """Runs of equal non-null labels over consecutive rows: ``label, start, end`` (exclusive), ``rows``.

    A null label breaks a run and belongs to none. Runs are found inside chunks of ``rows`` units of the index;
    a chunk whose first run goes on from the chunk before passes it to where that one began, by a table of one row
    a chunk. So a long recording is many tasks, and what is merged are runs, not rows.
    """
    cut = df.select(*by, F.col(index).alias("_i"), F.col(label).alias("_l")).withColumn("_chunk", F.floor(F.col("_i") / rows))
    w = Window.partitionBy(*by, "_chunk").orderBy("_i")
    new = (F.row_number().over(w) == 1) | ~F.col("_l").eqNullSafe(F.lag("_l").over(w))
    cut = cut.withColumn("_run", F.sum(new.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy(*by, "_chunk", "_run", "_l").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    runs = persist(runs, "runs")

    ends = F.max("_run").alias("_runs"), F.min_by(F.struct("_l"), "_run").alias("_first"), F.max_by(F.struct("_l"), "_run").alias("_last")
    order = Window.partitionBy(*by).orderBy("_chunk")
    chunks = runs.groupBy(*by, "_chunk").agg(*ends).withColumn("_goes_on", F.coalesce(F.col("_first") == F.lag("_last").over(order), F.lit(False)))
    # where the last run of each chunk began: in it, unless it is one run that goes on
    began = F.when((F.col("_runs") > 1) | ~F.col("_goes_on"), F.struct(F.col("_chunk"), F.col("_runs").alias("_run")))
    head = F.last(began, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = chunks.withColumn("_head", head).filter("_goes_on").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_chunk"])), F.lit(1).alias("_k"), "_head")
    keys = [*by, "_chunk", "_run"]
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}" if i < len(keys) - 1 else "_k")) for i, c in enumerate(keys)]
    own = F.coalesce("_head", F.struct(F.col("_chunk"), F.col("_run")))
    merged = with_small(runs.filter("_l is not null"), persist(heads, "heads"), same, "left").withColumn("_own", own)
    out = merged.groupBy(*by, "_own", "_l").agg(F.min("_lo").alias("start"), (F.max("_hi") + 1).alias("end"), F.sum("_n").alias("rows"))
    return out.select(*by, F.col("_l").alias(label), "start", "end", "rows")


def centred_windows(islands: DataFrame, half: int, step: int) -> DataFrame:
    """One row per centre whose whole window lies in the island: ``centre, first, last`` (exclusive)."""
    n = F.ceil((F.col("end") - F.col("start") - 2 * half) / step)
    slots = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    out = islands.select("*", F.explode(slots).alias("window_no"))
    centre = F.col("start") + half + F.col("window_no") * step
    return out.withColumn("centre", centre).withColumn("first", F.col("centre") - half).withColumn("last", F.col("centre") + half)


def centred_window_count(islands: DataFrame, half: int, step: int) -> Column:
    """How many windows :func:`centred_windows` would make, in closed form."""
    return F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start") - 2 * half) / step))


def slots_of(t: Column, start: Column, last: Column, window: float, stride: float, slack: float = 0.0) -> Column:
    """Numbers k of the windows [start + k*stride, start + k*stride + window) that hold ``t`` and end by ``last``."""
    at = t - start
    high = F.least(F.floor(at / stride), F.floor((last - start - window + slack) / stride))
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((at - window) / stride) + 1)
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _spanned(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """``df`` with the first and last time of its group, ``_t0`` and ``_t1``: an aggregate, not a window that holds the group."""
    span = df.groupBy(*by).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    span = span.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_t0", "_t1")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return df.join(span, same).select(*df.columns, "_t0", "_t1")


def anchored_windows(df: DataFrame, by: list[str], time: str, window: float, stride: float, slack: float = 0.0) -> DataFrame:
    """Rows of ``df`` once for each sliding window they are in, with ``window_id``, ``window_start``, ``window_end``.

    Windows start at the first row of the group and must end by its last; slots count whether kept or not.
    """
    spans = _spanned(df, by, time)
    slots = slots_of(F.col(time), F.col("_t0"), F.col("_t1"), window, stride, slack)
    out = spans.select("*", F.explode(slots).alias("window_id"))
    start = F.col("_t0") + F.col("window_id") * stride
    return out.withColumn("window_start", start).withColumn("window_end", start + window).drop("_t0", "_t1")


def downsampled_bins(df: DataFrame, by: list[str], time: str, rate: float, means: list[str], firsts: list[str]) -> DataFrame:
    """One row per time bin of 1/rate from the group's first time: means, first values, ``time`` on the grid."""
    rows = _spanned(df, by, time).withColumn("bin", F.floor((F.col(time) - F.col("_t0")) * rate))
    aggs = [F.avg(c).alias(c) for c in means] + [F.min_by(c, time).alias(c) for c in firsts]
    out = rows.groupBy(*by, "_t0", "bin").agg(*aggs)
    return out.withColumn(time, F.col("_t0") + F.col("bin") / rate).drop("_t0")


def mode_label(df: DataFrame, by: list[str], label: str, out: str = "label") -> DataFrame:
    """Most frequent non-null label of each group, the smallest on a tie; null if there is none."""
    counts = df.groupBy(*by, label).agg(F.count(label).alias("_n"))
    best = F.max(F.when(F.col(label).isNotNull(), F.struct(F.col("_n"), (-F.col(label)).alias("_l"))))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, (-F.col("_b._l")).alias(out))


def gathered(windows: DataFrame, signal: DataFrame, by: list[str], index: str, value: str, bucket: int) -> DataFrame:
    """Values of ``signal`` with ``first <= index < last`` for each window, in order, as ``values``.

    An interval join by buckets of the index: windows are exploded to the buckets they touch and meet rows
    by (key, bucket), a hash join; every row is compared with the windows of its bucket only.
    """
    touched = F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("last") - 1) / bucket))
    spread = windows.select("*", F.explode(touched).alias("_bucket"))
    rows = signal.select(*by, F.col(index).alias("_i"), F.col(value).alias("_v"), F.floor(F.col(index) / bucket).alias("_bucket"))
    met = spread.join(rows, [*by, "_bucket"]).filter("_i >= first and _i < last")
    listed = F.array_sort(F.collect_list(F.struct("_i", "_v")))
    return met.groupBy(*windows.columns).agg(F.transform(listed, lambda x: x["_v"]).alias("values"))


def second_stream(windows: DataFrame, rows: DataFrame, by: list[str], time: str, value: str, width: float, least: int) -> DataFrame:
    """``windows(by, window_start, window_end)`` with ``n`` and mean of the second stream's rows in [start, end).

    A left interval join by buckets of ``width``; streams with fewer than ``least`` rows give a null mean.
    """
    touched = F.sequence(F.floor(F.col("window_start") / width), F.floor(F.col("window_end") / width))
    keys = [*by, "window_id", "window_start", "window_end"]
    spread = windows.select(*keys, F.explode(touched).alias("_bucket"))
    other = rows.select(*by, F.col(time).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(time) / width).alias("_bucket"))
    met = spread.join(other, [*by, "_bucket"]).filter("_t >= window_start and _t < window_end")
    found = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"))
    out = windows.select(*keys).join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("m", F.when(F.col("n") >= least, F.col("m")))


def matched_segments(left: DataFrame, right: DataFrame, by: list[str], segment: str) -> DataFrame:
    """Each (group, segment) of ``left`` with the segment of ``right`` to use: same ordinal, else the whole group.

    ``right_segment``: the ordinal, -1 for the whole group, null if the group is missing.
    """
    a = left.select(*by, segment).distinct()
    b = right.select(*by, F.col(segment).alias("right_segment")).distinct()
    groups = b.select(*by).distinct().withColumn("_there", F.lit(True))
    same = a.join(b.withColumn(segment, F.col("right_segment")), [*by, segment], "left").join(groups, by, "left")
    pick = F.coalesce("right_segment", F.when(F.col("_there"), F.lit(-1).cast("bigint")))
    return same.select(*by, segment, pick.alias("right_segment"))


def purity(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Whether each group holds one distinct label."""
    return df.groupBy(*by).agg((F.min(label).eqNullSafe(F.max(label)) & (F.count(label) == F.count(F.lit(1)))).alias("pure"))
