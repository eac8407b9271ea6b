"""Live bars: tumbling OHLCV with a watermark, and indicators whose state lives between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def live_bars(ticks: DataFrame, tf: int, late: str = "10 minutes", price: str = "value") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, event_id and a price); ticks later than the watermark are dropped.

    In append mode a bar is emitted once the watermark has passed its end; in
    update mode with every change.
    """
    stamped = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at, px = F.struct("ts", "event_id"), F.col(price)
    bars = stamped.groupBy("symbol", F.window("ts", f"{tf} minutes").alias("w")).agg(F.min_by(px, at).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.lit(tf).alias("tf"), F.unix_timestamp("w.start").alias("time"), "open", "high", "low", "close", "volume")


ATR_STATE = "time long, close double, atr double, total double, seen int"
ATR_OUT = "symbol string, tf int, time long, close double, tr double, atr double"


def live_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Wilder's average range of a stream of closed bars, as the batch fold makes it; bars not after the last are ignored."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        time, close, atr, total, seen = state.get if state.exists else (-1, 0.0, 0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("time")
        out = []
        for r in rows.itertuples():
            if r.time <= time:
                continue
            tr = r.high - r.low if seen == 0 else max(r.high - r.low, abs(r.high - close), abs(r.low - close))
            seen += 1
            if seen <= period:
                total += tr
                atr = total / period
            else:
                atr = (atr * (period - 1) + tr) / period
            time, close = int(r.time), float(r.close)
            out.append((key[0], key[1], time, close, tr, atr if seen >= period else None))
        state.update((time, close, float(atr), float(total), seen))
        yield pd.DataFrame(out, columns=["symbol", "tf", "time", "close", "tr", "atr"])

    return bars.groupBy("symbol", "tf").applyInPandasWithState(step, ATR_OUT, ATR_STATE, "append", "NoTimeout")


def replay(bars: DataFrame, cursor: int) -> DataFrame:
    """What a live chart shows at bar `cursor`: the bars known then."""
    return bars.where(F.col("i") <= cursor)


def live_levels(bars: DataFrame) -> DataFrame:
    """Running session extremes of a stream of closed bars (update mode)."""
    day = F.floor(F.col("time") / 86400)
    return bars.groupBy("symbol", "tf", day.alias("day")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
