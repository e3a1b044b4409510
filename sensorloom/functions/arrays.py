"""Features of a window held as ``array<double>``: higher-order functions, no Python on the rows.

Standard deviations are population ones; NaN never enters (see :func:`clean`). Functions that use their
window more than once bind it first: an argument that is an expression would otherwise be written out at each
use, and inside a lambda be evaluated for each element.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept(value: Column) -> Column:
    """``value`` as a column that the optimizer leaves where it is, as it does not take it for deterministic.

    Written into a Python call, nested lambda functions would keep the call from being planned.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def bound(feature: Callable[..., Column]) -> Callable[..., Column]:
    """``feature`` with its first argument evaluated once a row."""

    @functools.wraps(feature)
    def run(x: Column, *more, **named) -> Column:
        return let(x, lambda v: feature(v, *more, **named))

    return run


def clean(x: Column) -> Column:
    """Finite values as doubles."""
    return F.filter(F.transform(x, lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


@bound
def variance(x: Column) -> Column:
    return let(mean(x), lambda m: mean(F.transform(x, lambda v: (v - m) * (v - m))))


def std(x: Column) -> Column:
    return F.sqrt(variance(x))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""

    def of(s: Column) -> Column:
        at = F.lit(q) * (F.size(s) - 1)
        lo = F.floor(at).cast("int")
        low, high = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, low + (high - low) * (at - lo))

    return let(F.array_sort(x), of)


@bound
def zscore(x: Column, zeros: bool = False) -> Column:
    """Standardised; of a constant window the deviations, or zeros if asked for."""
    stats = F.struct(mean(x).alias("m"), std(x).alias("s"))

    def one(st: Column) -> Column:
        flat = F.transform(x, lambda v: F.lit(0.0) if zeros else v - st["m"])
        return F.when(st["s"] < EPS, flat).otherwise(F.transform(x, lambda v: (v - st["m"]) / st["s"]))

    return F.when(F.size(x) > 0, let(stats, one)).otherwise(x)


@bound
def downsampled(x: Column, length: int) -> Column:
    """``length`` values at evenly spread places, truncated to integers; shorter windows stay."""
    n = F.size(x)
    step = (n - 1).cast("double") / (length - 1)
    place = lambda i: F.when(i == length - 1, n - 1).otherwise((i * step).cast("int"))
    return F.when(n > length, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(x, place(i)))).otherwise(x)


@bound
def differences(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)).otherwise(F.slice(x, 1, 0))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z")), lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]))


@bound
def slope(x: Column, rate: float = 1.0) -> Column:
    """Least-squares slope against index / rate; null for fewer than two values."""
    n = F.size(x).cast("double")
    mid = (n - 1) / 2
    dot = F.aggregate(F.transform(x, lambda v, i: (i - mid) * v), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(x) > 1, dot / (n * (n * n - 1) / 12) * rate)


@bound
def correlation_with_time(x: Column) -> Column:
    n = F.size(x).cast("double")
    sd = std(x)
    return F.when((F.size(x) > 1) & (sd > 0), slope(x) * F.sqrt((n * n - 1) / 12) / sd)


@bound
def rmssd(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.sqrt(mean(F.transform(differences(x), lambda d: d * d))))


@bound
def peak_count(x: Column) -> Column:
    """Strict local maxima above mean + std."""

    def of(limit: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(x) - 2)
        return F.size(F.filter(inner, lambda i: (F.get(x, i) > F.get(x, i - 1)) & (F.get(x, i) > F.get(x, i + 1)) & (F.get(x, i) > limit)))

    return F.when(F.size(x) > 2, let(mean(x) + std(x), of)).otherwise(F.lit(0))


@bound
def absolute_integral(x: Column, rate: float) -> Column:
    """Trapezoids of the absolute values."""
    a = F.transform(x, F.abs)
    return F.when(F.size(x) > 0, (total(a) - (F.get(a, F.lit(0)) + F.get(a, F.size(a) - 1)) / 2) / rate)


@bound
def moving_average(x: Column, width: int) -> Column:
    """Centred, zero-padded: always divided by the full (odd) width."""
    h = width // 2
    part = lambda i: F.slice(x, F.greatest(i - h, F.lit(0)) + 1, F.least(i + h, F.size(x) - 1) - F.greatest(i - h, F.lit(0)) + 1)
    return F.transform(x, lambda _, i: total(part(i)) / width)


@bound
def centre_crop(x: Column, length: int) -> Column:
    return F.when(F.size(x) > length, F.slice(x, F.floor((F.size(x) - length) / 2).cast("int") + 1, F.lit(length))).otherwise(x)


def endpoint_trend(x: Column) -> Column:
    d = F.get(x, F.size(x) - 1) - F.get(x, F.lit(0))
    far = F.abs(d) > F.greatest(std(x) * 0.25, F.lit(1e-6))
    return F.when(F.size(x) == 0, "empty").when(far & (d > 0), "increasing").when(far, "decreasing").otherwise("relatively stable")


@bound
def described(x: Column) -> Column:
    """mean, std, min, max, p25, p75 and trend."""
    return F.struct(
        mean(x).alias("mean"), std(x).alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"),
        quantile(x, 0.25).alias("p25"), quantile(x, 0.75).alias("p75"), endpoint_trend(x).alias("trend"),
    )


@bound
def edge_trend(x: Column, limit: float = 0.25) -> Column:
    """Mean of the last fifth against that of the first."""

    def of(edge: Column) -> Column:
        return mean(F.slice(x, F.size(x) - edge + 1, edge)) - mean(F.slice(x, F.lit(1), edge))

    d = let(F.greatest(F.lit(1), F.floor(F.size(x) / 5).cast("int")), of)
    flat = (F.size(x) < 3) | (std(x) < EPS)
    return F.when(flat, "stable").when(d > limit, "increasing").when(d < -limit, "decreasing").otherwise("stable")


@bound
def segments(x: Column, parts: int = 4) -> Column:
    """Consecutive parts; the first ``n % parts`` are one longer."""
    n, k = F.size(x), F.least(F.lit(parts), F.size(x))
    base, more = F.floor(n / k).cast("int"), n % k
    start = lambda i: (i * base + F.least(i, more)).cast("int")
    cut = lambda i: F.slice(x, start(i) + 1, (base + (i < more).cast("int")).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), cut)).otherwise(F.slice(F.array(x), 1, 0))


@bound
def segment_trends(x: Column, parts: int = 4) -> Column:
    return F.transform(segments(x, parts), lambda part: edge_trend(part))


@bound
def fluctuation(x: Column, low: float = 0.08, high: float = 0.35) -> Column:
    s = std(differences(x))
    return F.when(F.size(x) < 3, "unclear").when(s < low, "low").when(s > high, "high").otherwise("moderate")


@bound
def event_counts(x: Column, limit: float = 2.5) -> Column:
    """Peaks and valleys beyond ``limit``, and steps whose z-score is beyond it."""

    def sharp(i: Column) -> Column:
        a, b, c = F.get(x, i - 1), F.get(x, i), F.get(x, i + 1)
        return ((b > a) & (b > c) & (b > limit)) | ((b < a) & (b < c) & (b < -limit))

    peaks = F.when(F.size(x) > 2, F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 2), sharp))).otherwise(F.lit(0))
    steps = differences(x)
    stats = F.struct(mean(steps).alias("m"), std(steps).alias("s"))
    jumps = let(stats, lambda st: F.size(F.filter(steps, lambda d: F.abs((d - st["m"]) / st["s"]) > limit)))
    jumps = F.when((F.size(x) > 2) & (std(steps) > EPS), jumps).otherwise(F.lit(0))
    return F.struct(peaks.alias("peaks"), jumps.alias("changes"))


@bound
def periodicity(x: Column, strong: float = 0.60, some: float = 0.35) -> Column:
    """By the largest autocorrelation of the detrended window at lags from 2 up to half its length."""
    n = F.size(x)
    line = F.struct(slope(x).alias("b"), mean(x).alias("m"), ((n - 1) / 2).alias("c"))
    flat = let(line, lambda k: F.transform(x, lambda v, i: v - (k["m"] + k["b"] * (i - k["c"]))))

    def best(r: Column) -> Column:
        last = F.greatest(F.lit(3), F.floor(n / 2).cast("int")) - 1
        lagged = lambda k: F.aggregate(
            F.zip_with(F.slice(r, F.lit(1), n - k), F.slice(r, k + 1, n - k), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v
        )
        power = total(F.transform(r, lambda v: v * v))
        return F.when((std(r) >= EPS) & (power > 0), F.array_max(F.transform(F.sequence(F.lit(2), last), lagged)) / power)

    score = F.when((n >= 8) & (std(x) >= EPS), let(flat, best))
    return F.when(score >= strong, "strong").when(score >= some, "moderate").otherwise("weak or unclear")


@bound
def movement(x: Column) -> Column:
    """Steps beyond median + std of all steps: their number, and the share of steps that are not."""
    steps = F.transform(differences(x), F.abs)
    limit = quantile(steps, 0.5) + std(steps)
    limit = F.when(limit > 0, limit).otherwise(F.lit(EPS))
    count = let(limit, lambda t: F.size(F.filter(steps, lambda d: d > t)))
    count = F.when(F.size(x) > 1, count).otherwise(F.lit(0))
    still = F.when(F.size(x) > 1, 1 - count / F.size(steps)).otherwise(F.lit(1.0))
    return F.struct(count.alias("movements"), still.alias("stillness"))
