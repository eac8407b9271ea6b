"""Resampling, navigation and views of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import PRICES, with_index
from .core import along

TIMEFRAMES = (5, 15, 60, 120, 240, 1440, 10080)


def _ohlcv() -> list:
    return [F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")]


def resample(bars: DataFrame, tf: int) -> DataFrame:
    """Bars of tf minutes aligned to the epoch in UTC (a week starts on Thursday); empty buckets have no bar."""
    at = bars.withColumn("__t", F.floor(F.col("time") / (tf * 60)) * (tf * 60))
    out = at.groupBy("symbol", "__t").agg(*_ohlcv())
    return with_index(out.select("symbol", F.lit(tf).alias("tf"), F.col("__t").alias("time"), *PRICES, "volume"))


def resample_many(bars: DataFrame, timeframes: tuple[int, ...] = TIMEFRAMES) -> DataFrame:
    """All timeframes from one scan of the finest bars."""
    each = bars.drop("tf", "i").withColumn("tf", F.explode(F.array(*map(F.lit, timeframes))))
    at = each.withColumn("__t", F.floor(F.col("time") / (F.col("tf") * 60)) * F.col("tf") * 60)
    return with_index(at.groupBy("symbol", "tf", "__t").agg(*_ohlcv()).withColumnRenamed("__t", "time"))


def resample_local(bars: DataFrame, tf: int, offset: str = "tz_offset") -> DataFrame:
    """Bars aligned to local time by each row's offset, with end_time and the range of source bars."""
    s = tf * 60
    at = bars.withColumn("__t", F.floor((F.col("time") + F.col(offset)) / s) * s - F.col(offset))
    out = at.groupBy("symbol", "__t").agg(*_ohlcv(), F.min("i").alias("source_start"), F.max("i").alias("source_end"))
    return with_index(out.select("symbol", F.lit(tf).alias("tf"), F.col("__t").alias("time"), *PRICES, "volume", (F.col("__t") + s).alias("end_time"), "source_start", "source_end"))


def resample_extremes(bars: DataFrame, tf: int) -> DataFrame:
    """Bars with the first source bar that has the high and the first that has the low."""
    at = bars.withColumn("__t", F.floor(F.col("time") / (tf * 60)) * (tf * 60))
    first_high, first_low = F.min_by("i", F.struct((-F.col("high")).alias("h"), F.col("i"))), F.min_by("i", F.struct("low", "i"))
    out = at.groupBy("symbol", "__t").agg(*_ohlcv(), first_high.alias("high_index"), first_low.alias("low_index"), F.min("i").alias("source_start"), F.max("i").alias("source_end"))
    return with_index(out.withColumnRenamed("__t", "time").withColumn("tf", F.lit(tf)))


def volume_index(bars: DataFrame, tf: int, parts: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    """time of each tf bucket with v1m, v5m, v15m: volumes of the finer bars that start in it."""
    each = bars.select("symbol", "time", "volume", F.explode(F.array(*map(F.lit, parts))).alias("m"))
    start = F.floor(F.col("time") / (F.col("m") * 60)) * F.col("m") * 60
    at = each.withColumn("bucket", F.floor(start / (tf * 60)) * (tf * 60))
    sums = [F.sum(F.when(F.col("m") == m, F.col("volume")).otherwise(0.0)).alias(f"v{m}m") for m in parts]
    return at.groupBy("symbol", F.col("bucket").alias("time")).agg(*sums)


def with_volume(bars: DataFrame, index: DataFrame) -> DataFrame:
    """bars with their bucket's volumes, null where the index has none."""
    return bars.join(index, ["symbol", "time"], "left")


def rows(bars: DataFrame, first: int, last: int) -> DataFrame:
    return bars.where(F.col("i").between(max(0, first), last))


def prefix(bars: DataFrame, cursor: int) -> DataFrame:
    """What is known at the bar `cursor`."""
    return bars.where(F.col("i") <= max(0, cursor))


def last_bar(bars: DataFrame, cursor: int | None = None) -> DataFrame:
    known = bars if cursor is None else prefix(bars, cursor)
    bar = F.struct(*[c for c in bars.columns if c not in ("symbol", "tf")])
    return known.groupBy("symbol", "tf").agg(F.max_by(bar, "i").alias("bar"), F.count(F.lit(1)).alias("size")).select("symbol", "tf", "size", "bar.*")


def time_anchors(bars: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """Bars that open a local day or hour."""
    local = F.col("time") + offset_seconds
    day, hour = F.floor(local / 86400), F.floor(local / 3600)
    at = bars.withColumn("day", day).withColumn("hour", hour)
    new = lambda c: F.coalesce(F.lag(c).over(along()) != F.col(c), F.lit(True))
    at = at.withColumn("new_day", new("day")).withColumn("new_hour", new("hour"))
    return at.where("new_day or new_hour").select("symbol", "tf", "i", "time", "new_day", "new_hour")


def viewport(bars: DataFrame, visible: int, offset: int = 0, cursor: int | None = None) -> DataFrame:
    """The last `visible` bars, `offset` bars back from the end or the cursor; 15 % of the width stays free to the right."""
    shown = max(1, int(visible * 0.85))
    known = bars if cursor is None else prefix(bars, cursor)
    back = F.max("i").over(Window.partitionBy("symbol", "tf")) - F.col("i") - offset
    return known.withColumn("__back", back).where((F.col("__back") >= 0) & (F.col("__back") < shown)).drop("__back")


def y_range(bars: DataFrame) -> DataFrame:
    """Padded price range and volume top of the bars given."""
    out = bars.groupBy("symbol", "tf").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("volume").alias("v"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.06, F.lit(0.5))
    return out.select("symbol", "tf", (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"), (F.col("v") * 1.15).alias("volume_max"))


def nice_ticks(lo: float, hi: float, most: int = 8) -> list[float]:
    """Axis ticks at steps of 1, 2.5, 5 or 10 times a power of ten."""
    import math

    if hi <= lo:
        return [lo]
    raw = (hi - lo) / max(1, most)
    base = 10 ** math.floor(math.log10(raw))
    step = next(m * base for m in (1, 2.5, 5, 10) if m * base >= raw)
    first = math.ceil(lo / step)
    return [k * step for k in range(first, math.floor(hi / step) + 1)]
