"""Numbers for each bar: ranges, averages, trend filters, regime features.

Frames that look back a fixed number of bars are windows, and averages that
decay are sums over stretches of bars. Recurrences with a choice in them run in
one fold that returns all of them, so a series crosses to Python once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, along, fold, rows_between

NaN = float("nan")


def true_range(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(along())
    spread = F.col("high") - F.col("low")
    tr = F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return bars.withColumn("tr", F.when(before.isNull(), spread).otherwise(tr))


def volume_average(bars: DataFrame, window: int = 20, times: float = 1.35) -> DataFrame:
    mean = F.avg("volume").over(rows_between(-(window - 1), 0))
    return bars.withColumn("volume_average", mean).withColumn("high_volume", (F.col("volume_average") > 0) & (F.col("volume") >= F.col("volume_average") * times))


def regime_features(bars: DataFrame, atr: Column | None = None, window: int = 20) -> DataFrame:
    """return_1, trend_return, volatility, atr_pct, volume_ratio and available (i >= window)."""
    before, anchor = F.lag("close").over(along()), F.lag("close", window).over(along())
    frame = rows_between(-(window - 1), 0)
    out = bars.withColumn("return_1", F.coalesce(F.try_divide(F.col("close"), before) - 1, F.lit(0.0)))
    out = out.withColumn("trend_return", F.coalesce(F.try_divide(F.col("close"), anchor) - 1, F.lit(0.0)))
    out = out.withColumn("volatility", F.coalesce(F.stddev_samp("return_1").over(frame), F.lit(0.0)))
    spread = F.try_divide(F.abs(F.col("high") - F.col("low")), F.abs("close"))
    out = out.withColumn("atr_pct", F.coalesce(F.abs(F.try_divide(atr, F.col("close"))) if atr is not None else F.lit(None), spread, F.lit(0.0)))
    mean = F.avg("volume").over(frame)
    out = out.withColumn("volume_ratio", F.when(mean > 0, F.col("volume") / mean).otherwise(1.0))
    return out.withColumn("available", F.col("i") >= window)


def regression_channel(bars: DataFrame) -> DataFrame:
    """Least-squares line of close over the bars given, with the furthest high above and low below it."""
    lines = bars.groupBy("symbol", "tf").agg(F.regr_slope("close", "i").alias("slope"), F.regr_intercept("close", "i").alias("intercept"), F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))
    at = bars.join(lines.where("n >= 3 and last - first >= 2"), ["symbol", "tf"])
    fit = F.col("slope") * F.col("i") + F.col("intercept")
    return at.groupBy("symbol", "tf", "slope", "intercept", "n").agg(F.greatest(F.max(F.col("high") - fit), F.lit(0.0)).alias("upper"), F.greatest(F.max(fit - F.col("low")), F.lit(0.0)).alias("lower"))


def pivot_regression(pivots: DataFrame) -> DataFrame:
    """Least-squares line through pivots (i, price) and the spread of their residuals."""
    lines = pivots.groupBy("symbol", "tf").agg(F.regr_slope("price", "i").alias("slope"), F.regr_intercept("price", "i").alias("intercept"), F.count(F.lit(1)).alias("n"))
    at = pivots.join(lines.where("n >= 2"), ["symbol", "tf"])
    rest = F.col("price") - F.col("slope") * F.col("i") - F.col("intercept")
    return at.groupBy("symbol", "tf", "slope", "intercept", "n").agg(F.sqrt(F.sum(rest * rest) / F.col("n")).alias("sigma"))


def wilder(tr: np.ndarray, period: int, seed_at: int) -> np.ndarray:
    """Wilder's average: the mean of `period` ranges that end at seed_at, then the recurrence; NaN before."""
    out = np.full(len(tr), NaN)
    if len(tr) <= seed_at:
        return out
    total = 0.0
    for x in tr[seed_at - period + 1 : seed_at + 1]:
        total += x
    value = out[seed_at] = total / period
    for i in range(seed_at + 1, len(tr)):
        value = out[i] = (value * (period - 1) + tr[i]) / period
    return out


def ema(x: np.ndarray, period: int) -> np.ndarray:
    out, k = np.empty(len(x)), 2 / (period + 1)
    value = x[0]
    for i, v in enumerate(x):
        value = out[i] = v if i == 0 else v * k + value * (1 - k)
    return out


def decayed(rows: DataFrame, step: Column, decay: float, to: str) -> DataFrame:
    """rows with `to`, the recurrence y(i) = decay y(i - 1) + step(i) from 0, without a pass from bar to bar.

    A series is cut into stretches over which the decay falls to about 1e-8.
    Within one, y is a running sum of steps weighted by their age; what came
    before a stretch enters through the weighted sums of the three stretches
    before it, as older ones weigh less than 1e-24. So stretches of one series
    are computed in parallel, by windows that hold a stretch each.
    """
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    n = max(1, math.ceil(math.log(1e-8) / math.log(decay)))
    at = rows.withColumn("__c", F.floor(F.col("i") / n)).withColumn("__k", F.col("i") - F.col("__c") * n).withColumn("__b", step)
    own = F.sum(F.col("__b") * F.pow(F.lit(decay), -F.col("__k"))).over(Window.partitionBy(*KEY, "__c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ends = at.groupBy(*KEY, "__c").agg(F.sum(F.col("__b") * F.pow(F.lit(decay), n - 1 - F.col("__k"))).alias("e"))
    later = F.explode(F.array(*[F.struct((F.col("__c") + k + 1).alias("__c"), (F.col("e") * decay ** (n * k)).alias("e")) for k in range(3)]))
    carried = ends.select(*KEY, later.alias("x")).groupBy(*KEY, F.col("x.__c").alias("__c")).agg(F.sum("x.e").alias("__e"))
    y = F.pow(F.lit(decay), F.col("__k")) * own + F.pow(F.lit(decay), F.col("__k") + 1) * F.coalesce("__e", F.lit(0.0))
    return at.join(carried, [*KEY, "__c"], "left").withColumn(to, y).select(*rows.columns, to)


def average_true_range(bars: DataFrame, period: int = 14, *, late: bool = False, to: str = "atr") -> DataFrame:
    """bars with Wilder's average of the true range, null before its seed: the mean of the first `period` ranges, or (late) of those after the first bar."""
    seed_at = period if late else period - 1
    at = true_range(bars).withColumn("__mean", F.avg("tr").over(rows_between(-(period - 1), 0)))
    step = F.when(F.col("i") > seed_at, F.col("tr") / period).when(F.col("i") == seed_at, F.col("__mean")).otherwise(0.0)
    if period == 1:
        return at.withColumn(to, F.when(F.col("i") >= seed_at, F.col("tr"))).drop("tr", "__mean")
    out = decayed(at, step, (period - 1) / period, to)
    return out.withColumn(to, F.when(F.col("i") >= seed_at, F.col(to))).drop("tr", "__mean")


def exponential_average(bars: DataFrame, value: str, period: int, to: str) -> DataFrame:
    """bars with the exponential average of a column, which begins with its first value."""
    k = 2 / (period + 1)
    if period == 1:
        return bars.withColumn(to, F.col(value))
    return decayed(bars, F.when(F.col("i") == 0, F.col(value)).otherwise(F.col(value) * k), 1 - k, to)


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, times: float) -> tuple[np.ndarray, ...]:
    """value, direction, upper, lower: bands only tighten until the close before has crossed them."""
    n = len(close)
    value, way, upper, lower = np.empty(n), np.empty(n, int), np.empty(n), np.empty(n)
    up = down = 0.0
    side = 1
    for i in range(n):
        mid, reach = (high[i] + low[i]) / 2, times * (0.0 if np.isnan(atr[i]) else atr[i])
        top, bottom = mid + reach, mid - reach
        if i:
            was = close[i - 1]
            if not (top < up or was > up):
                top = up
            if not (bottom > down or was < down):
                bottom = down
            if side == -1 and close[i] > up:
                side = 1
            elif side == 1 and close[i] < down:
                side = -1
        up, down = top, bottom
        value[i], way[i], upper[i], lower[i] = (down if side == 1 else up), side, up, down
    return value, way, upper, lower


def _rolling(x: np.ndarray, size: int, how: np.ufunc, fill: float) -> np.ndarray:
    """how() over the last `size` values of each bar, fewer at the start."""
    out = x.astype(float).copy()
    for k in range(1, min(size, len(x))):
        out[k:] = how(out[k:], x[:-k])
    return out


def halftrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, amplitude: int, deviation: float) -> tuple[np.ndarray, ...]:
    """trend (0 up, 1 down), value, atr_high, atr_low, flipped.

    A scan for turns first: it seeks a turn up (+1) or down (-1) from an edge,
    the least of the rolling highs or the greatest of the rolling lows since the
    turn before. Then the line, stretch by stretch: from the value before the
    turn it only rises with the edge, or only falls.
    """
    n = len(close)
    top, bottom = _rolling(high, amplitude, np.maximum, -np.inf), _rolling(low, amplitude, np.minimum, np.inf)
    size = np.minimum(np.arange(1, n + 1), amplitude)
    mean = {1: _rolling(low, amplitude, np.add, 0.0) / size, -1: _rolling(high, amplitude, np.add, 0.0) / size}
    past = {way: np.concatenate([x[:1], x[:-1]]) for way, x in ((1, high), (-1, low))}
    edges, side = np.full(n, low[0]), np.ones(n, int)
    edge, seek, first = high[0], 1, True
    for i in range(n):
        edge = min(edge, top[i]) if seek > 0 else max(edge, bottom[i])
        if seek * (mean[seek][i] - edge) > 0 and seek * (close[i] - past[seek][i]) > 0:
            edge, seek, first = (bottom if seek > 0 else top)[i], -seek, False
        side[i] = -seek if not first else 1
        edges[i] = low[0] if first else edge
    starts = np.flatnonzero(np.diff(side, prepend=side[0]))
    value, before = np.empty(n), 0.0
    for lo, hi in zip([0, *starts], [*starts, n], strict=True):
        run = edges[lo:hi].copy()
        if lo:
            run[0] = before
        elif n:
            run[0] = max(run[0], before)
        if side[lo] < 0 and run[0] == 0 and len(run) > 1:
            run[0] = np.inf
        value[lo:hi] = (np.maximum if side[lo] > 0 else np.minimum).accumulate(run)
        if lo and np.isinf(value[lo]):
            value[lo] = 0.0
        before = value[hi - 1]
    flips = np.zeros(n, int)
    flips[starts] = 1
    band = deviation * np.where(np.isnan(atr), 0.0, atr) / 2
    return (side < 0).astype(int), value, value + band, value - band, flips


def range_filter(close: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """value and direction: the filter follows the close no nearer than the smoothed range."""
    n = len(close)
    value, way = np.empty(n), np.zeros(n, int)
    last, side = close[0], 0
    for i in range(n):
        now = max(last, close[i] - smooth[i]) if close[i] > last else min(last, close[i] + smooth[i]) if close[i] < last else last
        side = 1 if now > last else -1 if now < last else side
        last = value[i] = now
        way[i] = side
    return value, way


SCHEMA = "i int, time long, open double, high double, low double, close double, volume double, tr double, atr double, atr_late double, atr_zero double, ema_volume double, st_value double, st_direction int, st_upper double, st_lower double, ht_trend int, ht_value double, ht_high double, ht_low double, ht_flipped int, rf_value double, rf_direction int, rf_high double, rf_low double"


def indicators(bars: DataFrame, *, atr_period: int = 14, ema_period: int = 9, st_period: int = 10, st_times: float = 3.0, ht_amplitude: int = 2, ht_deviation: float = 2.0, rf_period: int = 100, rf_times: float = 3.0, warmup: str = "null") -> DataFrame:
    """All recurrences of a series in one fold.

    atr is seeded at bar period-1; atr_late at bar period by the ranges 1 to
    period; atr_zero is atr_late with st_period, whose warm-up is null, or that
    first value for warmup="backfill" (which looks ahead).
    """

    def kernel(b: dict[str, np.ndarray]) -> dict:
        high, low, close = b["high"], b["low"], b["close"]
        before = np.concatenate([[NaN], close[:-1]])
        tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        zero = wilder(tr, st_period, st_period)
        if warmup == "backfill" and len(zero) > st_period:
            zero[:st_period] = zero[st_period]
        st = supertrend(high, low, close, zero, st_times)
        ht = halftrend(high, low, close, zero, ht_amplitude, ht_deviation)
        smooth = ema(np.abs(high - low), rf_period) * rf_times
        rf = range_filter(close, smooth)
        out = {k: b[k] for k in ("i", "time", "open", "high", "low", "close", "volume")} | {"tr": tr, "atr": wilder(tr, atr_period, atr_period - 1), "atr_late": wilder(tr, atr_period, atr_period), "atr_zero": zero, "ema_volume": ema(b["volume"], ema_period)}
        out |= dict(zip(("st_value", "st_direction", "st_upper", "st_lower"), st, strict=True)) | dict(zip(("ht_trend", "ht_value", "ht_high", "ht_low", "ht_flipped"), ht, strict=True))
        return out | {"rf_value": rf[0], "rf_direction": rf[1], "rf_high": rf[0] + smooth, "rf_low": rf[0] - smooth}

    out = fold(bars.select("symbol", "tf", "i", "time", "open", "high", "low", "close", "volume"), kernel, SCHEMA)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("atr", "atr_late", "atr_zero")})
