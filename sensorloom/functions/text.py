"""Number formats as Python prints them, which JVM formats do not match (half-even on the exact double)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNAVAILABLE = "unavailable due to insufficient signal"


def formatted(x: Column, spec: str, missing: str = UNAVAILABLE) -> Column:
    """``format(x, spec)`` such as ``.3f`` or ``.4g``; null gives ``missing``."""

    @F.pandas_udf("string")
    def fmt(values: pd.Series) -> pd.Series:
        return pd.Series([missing if pd.isna(v) else format(float(v), spec) for v in values])

    return fmt(x.cast("double"))


def rounded_list(x: Column, digits: int = 3) -> Column:
    """``[0.1, 0.25]``: values rounded like Python's ``round`` and printed like its lists."""

    @F.pandas_udf("string")
    def show(lists: pd.Series) -> pd.Series:
        return pd.Series(["[]" if v is None else str([round(float(i), digits) for i in v]) for v in lists])

    return show(x)
