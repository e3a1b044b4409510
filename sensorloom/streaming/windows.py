"""Streaming forms of segmentation and anchored windows.

Sessions use Spark's own session windows under a watermark. Anchored windows start at a recording's first
event, which no built-in window expresses; they are kept per recording in a state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, by: list[str], time: str, value: str, gap_seconds: int, late: str) -> DataFrame:
    """Gap segments of a stream with count and mean; events later than ``late`` are dropped."""
    marked = stream.withWatermark(time, late)
    out = marked.groupBy(*by, F.session_window(time, f"{gap_seconds} seconds").alias("s"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "mean")


def anchored(stream: DataFrame, by: str, time: str, value: str, window: float, stride: float, late: str) -> DataFrame:
    """Sliding windows from each recording's first event: ``by, window_id, n, mean``, emitted once past.

    ``time`` is a timestamp. State per recording: its anchor, the next window and the rows that windows still need.
    A recording whose last event the watermark has left behind by a window ends: its state goes, and a later event
    begins a recording anew.
    """
    kind = dict(stream.dtypes)[by]
    schema = f"{by} {kind}, window_id long, n long, mean double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=[by, "window_id", "n", "mean"])
            return
        anchor, nxt, times, values = state.get if state.exists else (None, 0, [], [])
        rows = sorted([*zip(times, values), *((t.timestamp(), float(v)) for b in batches for t, v in zip(b[time], b[value]))])
        if anchor is None and rows:
            anchor = rows[0][0]
        out, last = [], rows[-1][0] if rows else None
        while rows and anchor + nxt * stride + window <= rows[-1][0]:
            start = anchor + nxt * stride
            held = [v for t, v in rows if start <= t < start + window]
            if held:
                out.append((key[0], nxt, len(held), sum(held) / len(held)))
            nxt += 1
            rows = [(t, v) for t, v in rows if t >= anchor + nxt * stride]
        state.update((anchor, nxt, [t for t, _ in rows], [v for _, v in rows]))
        if last is not None:
            state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "window_id", "n", "mean"])

    marked = stream.withWatermark(time, late).select(by, time, value)
    return marked.groupBy(by).applyInPandasWithState(step, schema, "anchor double, nxt long, times array<double>, vals array<double>", "append", "EventTimeTimeout")
