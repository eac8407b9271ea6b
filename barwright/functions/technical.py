"""Bar functions as window expressions: moving averages, oscillators, crossings.

Each takes column names or columns of a bar table and looks back along the
series. What needs more than one window takes and returns bars (with_…); the
parabolic stop and reverse is operators.channels.parallel_stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..operators.core import KEY, along, rows_between
from ..operators.series import decayed


def _back(n: int) -> WindowSpec:
    return rows_between(-(n - 1), 0)


def _full(value: Column, n: int) -> Column:
    """Null until n bars are there."""
    return F.when(F.count(F.lit(1)).over(_back(n)) == n, value)


def change(x: Column | str, n: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x - F.lag(x, n).over(along())


def sma(x: Column | str, n: int) -> Column:
    return _full(F.avg(x).over(_back(n)), n)


def wma(x: Column | str, n: int) -> Column:
    """Weights 1 to n, the last bar's the greatest."""
    x = F.col(x) if isinstance(x, str) else x
    return sum(((n - k) * F.lag(x, k).over(along()) for k in range(n)), F.lit(0.0)) / (n * (n + 1) / 2)


def swma(x: Column | str) -> Column:
    """Four bars with weights 1, 2, 2, 1."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.lag(x, 3).over(along()) + 2 * F.lag(x, 2).over(along()) + 2 * F.lag(x, 1).over(along()) + x) / 6


def vwma(x: Column | str, n: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _full(F.try_divide(F.sum(x * F.col("volume")).over(_back(n)), F.sum("volume").over(_back(n))), n)


def stdev(x: Column | str, n: int) -> Column:
    return _full(F.stddev_pop(x).over(_back(n)), n)


def variance(x: Column | str, n: int) -> Column:
    return _full(F.var_pop(x).over(_back(n)), n)


def deviation(x: Column | str, n: int) -> Column:
    """Mean absolute difference to the mean of the last n."""
    mean = F.avg(x).over(_back(n))
    values = F.collect_list(x).over(_back(n))
    return _full(F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n, n)


def highest(x: Column | str, n: int) -> Column:
    return _full(F.max(x).over(_back(n)), n)


def lowest(x: Column | str, n: int) -> Column:
    return _full(F.min(x).over(_back(n)), n)


def highest_bars(x: Column | str, n: int) -> Column:
    """Bars since the highest of the last n, as a number of 0 or less (the latest on ties)."""
    return _full(F.max_by("i", F.struct(F.col(x) if isinstance(x, str) else x, F.col("i"))).over(_back(n)) - F.col("i"), n)


def lowest_bars(x: Column | str, n: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _full(F.max_by("i", F.struct((-x).alias("x"), F.col("i"))).over(_back(n)) - F.col("i"), n)


def cum(x: Column | str) -> Column:
    return F.sum(x).over(along().rowsBetween(-(1 << 63), 0))


def stoch(n: int) -> Column:
    lo, hi = lowest("low", n), highest("high", n)
    return 100 * F.try_divide(F.col("close") - lo, hi - lo)


def crossover(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce((a > b) & (F.lag(a).over(along()) <= F.lag(b).over(along())), F.lit(False))


def crossunder(a: Column | str, b: Column | str) -> Column:
    return crossover(b, a)


def cross(a: Column | str, b: Column | str) -> Column:
    return crossover(a, b) | crossunder(a, b)


def bars_since(condition: Column) -> Column:
    return F.col("i") - F.last(F.when(condition, F.col("i")), ignorenulls=True).over(along().rowsBetween(-(1 << 63), 0))


def value_when(condition: Column, x: Column | str) -> Column:
    """x at the last bar that met the condition."""
    x = F.col(x) if isinstance(x, str) else x
    return F.last(F.when(condition, F.struct(x.alias("x"))), ignorenulls=True).over(along().rowsBetween(-(1 << 63), 0))["x"]


def with_value_when(bars: DataFrame, condition: Column, x: Column | str, occurrence: int, to: str) -> DataFrame:
    """bars with `to`, x at the bar that met the condition `occurrence` such bars before the last one (0: the last).

    Bars that meet it are numbered, and a bar looks up the number that it is
    due: no bar carries the ones before it.
    """
    x = F.col(x) if isinstance(x, str) else x
    upto = along().rowsBetween(-(1 << 63), 0)
    at = bars.withColumn("__met", F.coalesce(condition, F.lit(False))).withColumn("__n", F.count_if("__met").over(upto))
    hits = at.where("__met").select(*KEY, F.col("__n").alias("__due"), x.alias(to))
    return at.withColumn("__due", F.col("__n") - occurrence).join(hits, [*KEY, "__due"], "left").select(*bars.columns, to)


def with_rma(bars: DataFrame, x: str, n: int, to: str, first: int = 0) -> DataFrame:
    """bars with `to`, Wilder's average of x from bar `first` on, null before its seed, the mean of its first n."""
    seed_at = first + n - 1
    at = bars.withColumn("__mean", F.avg(x).over(_back(n)))
    step = F.when(F.col("i") > seed_at, F.col(x) / n).when(F.col("i") == seed_at, F.col("__mean")).otherwise(0.0)
    out = decayed(at, step, (n - 1) / n, to) if n > 1 else at.withColumn(to, F.col(x))
    return out.withColumn(to, F.when(F.col("i") >= seed_at, F.col(to))).drop("__mean")


def with_rsi(bars: DataFrame, n: int = 14, to: str = "rsi", x: str = "close") -> DataFrame:
    """bars with `to`, the relative strength index: Wilder's averages of rises and falls, 100 without falls."""
    at = bars.withColumn("__d", change(x)).withColumns({"__up": F.greatest("__d", F.lit(0.0)), "__down": F.greatest(-F.col("__d"), F.lit(0.0))})
    at = with_rma(with_rma(at, "__up", n, "__ru", 1), "__down", n, "__rd", 1)
    value = F.when(F.col("__rd") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("__ru"), F.col("__rd"))))
    return at.withColumn(to, F.when(F.col("__rd").isNotNull(), value)).select(*bars.columns, to)


def with_hma(bars: DataFrame, x: str, n: int, to: str) -> DataFrame:
    """bars with `to`, the Hull average: the weighted average, over sqrt(n) bars, of twice that of n / 2 less that of n."""
    at = bars.withColumn("__raw", 2 * wma(x, n // 2) - wma(x, n))
    return at.withColumn(to, wma("__raw", round(n**0.5))).drop("__raw")


def pivot_points() -> dict[str, Column]:
    """Classic pivot levels of the bar before."""
    h, l, c = (F.lag(x).over(along()) for x in ("high", "low", "close"))
    p = (h + l + c) / 3
    return {"p": p, "r1": 2 * p - l, "s1": 2 * p - h, "r2": p + (h - l), "s2": p - (h - l), "r3": h + 2 * (p - l), "s3": l - 2 * (h - p)}
