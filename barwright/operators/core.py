"""What the bar operators share: the key, windows, and ordered folds over one series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["symbol", "tf"]
#: Schema prefix of every result that a fold returns.
KEY_SCHEMA = "symbol string, tf int, "


def along(*partition: str, order: str = "i") -> WindowSpec:
    return Window.partitionBy(*KEY, *partition).orderBy(order)


def rows_between(lo: int, hi: int, *partition: str) -> WindowSpec:
    return along(*partition).rowsBetween(lo, hi)


def fold(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict | pd.DataFrame], schema: str, order: list[str] | None = None) -> DataFrame:
    """kernel over each series in order; it gets the columns as arrays and returns columns (schema, without the key).

    A recurrence reads its own last value, so one series is one task; series
    run in parallel.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order or ["i"], kind="stable")
        out = pd.DataFrame(kernel({c: pdf[c].to_numpy() for c in pdf.columns}), columns=names)
        out.insert(0, "tf", pdf["tf"].iloc[0])
        out.insert(0, "symbol", pdf["symbol"].iloc[0])
        return out

    return df.groupBy(*KEY).applyInPandas(run, KEY_SCHEMA + schema)


def fold_two(bars: DataFrame, events: DataFrame, kernel, schema: str, order: list[str]) -> DataFrame:
    """As fold(), with a second table of the same series: kernel(bars, events)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["symbol", "tf", *names])
        right.columns = names_of_events
        left, right = left.sort_values("i", kind="stable"), right.sort_values(order, kind="stable")
        out = pd.DataFrame(kernel({c: left[c].to_numpy() for c in left.columns}, right.to_dict("records")), columns=names)
        out.insert(0, "tf", left["tf"].iloc[0])
        out.insert(0, "symbol", left["symbol"].iloc[0])
        return out

    # both sides often come from one table; other names keep their columns apart
    names_of_events = events.columns
    renamed = events.select(*[F.col(c).alias(f"__{c}") for c in names_of_events])
    return bars.groupBy(*KEY).cogroup(renamed.groupBy(*[f"__{c}" for c in KEY])).applyInPandas(run, KEY_SCHEMA + schema)
