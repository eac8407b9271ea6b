"""Signals from trend filters, supply and demand zones, and the bar-by-bar backtest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, along, fold, fold_two, rows_between

SIGNAL_SCHEMA = "i int, time long, side string, trigger_i int, expires_i int, passed int, confidence double"


@dataclass(frozen=True)
class SignalConfig:
    main: str = "supertrend"
    confirmations: tuple[str, ...] = ()
    mode: str = "AND"
    expiry: int = 3
    alternating: bool = False


def directions(indicators: DataFrame) -> DataFrame:
    """The filters' directions as +1, -1 or 0, one column each."""
    return indicators.select(*KEY, "i", "time", F.col("st_direction").alias("supertrend"), F.when(F.col("ht_trend") == 0, 1).otherwise(-1).alias("halftrend"), F.col("rf_direction").alias("range_filter"))


def signals(ways: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """A turn of the main filter waits up to `expiry` bars for its confirmations; one row for each signal."""
    checks = [c for c in config.confirmations if c != config.main]
    expiry = max(1, config.expiry)

    def kernel(b: dict[str, np.ndarray]) -> list[tuple]:
        main, out, pending, last = b[config.main], [], None, None
        for i in range(len(main)):
            if i and main[i] and main[i - 1] and main[i] != main[i - 1]:
                pending = (main[i], i)
            if not pending:
                continue
            way, trigger = pending
            if i > trigger + expiry:
                pending = None
                continue
            passed = sum(b[c][i] == way for c in checks)
            if not checks or (passed == len(checks) if config.mode == "AND" else passed):
                side = "LONG" if way > 0 else "SHORT"
                if not (config.alternating and side == last):
                    out.append((i, b["time"][i], side, trigger, trigger + expiry, passed, passed / len(checks) if checks else 1.0))
                    last = side
                pending = None
        return out

    return fold(ways, kernel, SIGNAL_SCHEMA)


def supply_demand(blocks: DataFrame, bars: DataFrame, *, share: float = 0.7, causal: bool = True, window: int = 100) -> DataFrame:
    """Order blocks whose bar's volume reaches a nearest-rank percentile: of the last `window` bars up to
    confirmation, or, not causal, of all order blocks' bars (which looks ahead)."""
    own = bars.select(*KEY, "i", F.col("volume").alias("zone_volume"))
    at = blocks.join(own, [*KEY, "i"])
    rank = lambda a: F.get(a, F.floor((F.size(a) - 1) * share + 0.5).cast("int"))
    if causal:
        recent = F.sort_array(F.filter(F.collect_list("volume").over(rows_between(-(window - 1), 0)), lambda v: v > 0))
        least = bars.select(*KEY, F.col("i").alias("confirmed_i"), rank(recent).alias("least"))
        at = at.join(least, [*KEY, "confirmed_i"], "left")
    else:
        least = at.where("zone_volume > 0").groupBy(*KEY).agg(F.sort_array(F.collect_list("zone_volume")).alias("v")).select(*KEY, rank(F.col("v")).alias("least"))
        at = at.join(least, KEY, "left")
    return at.where(F.col("zone_volume") >= F.coalesce("least", F.lit(0.0))).withColumn("zone", F.when(F.col("direction") == "bear", "supply").otherwise("demand"))


def untouched(zones: DataFrame, bars: DataFrame, cursor: int, newest: int = 15) -> DataFrame:
    """Zones that no bar has touched from confirmation to the cursor, newest first."""
    from .joins import within

    known = zones.where(F.col("confirmed_i") <= cursor).withColumn("__from", F.col("confirmed_i") + 1).withColumn("__to", F.lit(cursor)).withColumnRenamed("i", "zone_i")
    hit = within(bars.select(*KEY, "i", "high", "low").where(F.col("i") <= cursor), known.select(*KEY, "zone_i", "zone", "top", "bottom", "confirmed_i", "__from", "__to"), "i", "__from", "__to")
    hit = hit.where(F.when(F.col("zone") == "demand", F.col("low") <= F.col("top")).otherwise(F.col("high") >= F.col("bottom"))).select(*KEY, "zone_i", "zone", "confirmed_i").distinct()
    left = known.join(hit, [*KEY, "zone_i", "zone", "confirmed_i"], "left_anti").drop("__from", "__to")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confirmed_i"), F.desc("zone_i")))
    return left.withColumn("place", place).where(F.col("place") <= newest).withColumnRenamed("zone_i", "i")


@dataclass(frozen=True)
class BacktestConfig:
    initial_capital: float = 10_000.0
    risk_per_trade: float = 0.01
    max_leverage: float = 1.0
    stop_atr: float = 1.5
    reward_risk: float = 2.0
    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    target_first: bool = False

    def __post_init__(self):
        if not (self.initial_capital > 0 and 0 < self.risk_per_trade <= 1 and self.max_leverage > 0 and self.stop_atr > 0 and self.reward_risk > 0):
            raise ValueError("capital, risk (at most 1), leverage, stop and reward must be positive")
        if self.commission_bps < 0 or self.slippage_bps < 0:
            raise ValueError("costs can't be negative")


BACKTEST_SCHEMA = "row string, signal_i int, i int, exit_i int, side string, entry_price double, exit_price double, stop_price double, target_price double, units double, reason string, gross_pnl double, net_pnl double, r_multiple double, equity double, regime string"


def backtest(bars: DataFrame, found: DataFrame, config: BacktestConfig = BacktestConfig(), *, curve: bool = False) -> DataFrame:
    """Trades, skipped signals (and the marked equity of each bar) as rows of one table, told apart by `row`.

    A signal enters at the next open if no position was open as the bar began;
    a bar may exit by its stop or target (the stop first, unless target_first),
    at the open where it gaps beyond. bars need column atr; found may have
    stop_price, take_profit_price and regime.
    """
    slip, fee = config.slippage_bps / 1e4, config.commission_bps / 1e4

    def none(x) -> bool:
        return x is None or (isinstance(x, float) and np.isnan(x))

    def kernel(b: dict[str, np.ndarray], rows: list[dict]) -> list[tuple]:
        open_, high, low, close, atr, n = b["open"], b["high"], b["low"], b["close"], b["atr"].astype(float), len(b["open"])
        out: list[tuple] = []
        equity, held = config.initial_capital, None
        entries: dict[int, list[dict]] = {}

        def skip(s: dict, at: int | None, why: str) -> None:
            out.append(("skipped", s["i"], at, None, s["side"], None, None, None, None, None, why, None, None, None, None, s.get("regime")))

        for s in rows:
            if s.get("side") not in ("LONG", "SHORT"):
                continue
            if none(s["i"]):
                skip(s | {"i": None}, None, "missing_signal_index")
            elif s["i"] + 1 >= n:
                skip(s, s["i"] + 1, "no_next_open")
            else:
                entries.setdefault(int(s["i"]) + 1, []).append(s)

        def leaves(p: dict, i: int) -> tuple[float, str] | None:
            w = p["way"]
            stopped = low[i] <= p["stop"] if w > 0 else high[i] >= p["stop"]
            reached = high[i] >= p["target"] if w > 0 else low[i] <= p["target"]
            if not (stopped or reached):
                return None
            by_stop = stopped and not (reached and config.target_first)
            level = p["stop"] if by_stop else p["target"]
            gapped = w * open_[i] < w * level if by_stop else w * open_[i] > w * level
            return (open_[i] if gapped else level), "stop" if by_stop else "target"

        def close_at(p: dict, raw: float, i: int, why: str) -> float:
            price = raw * (1 - p["way"] * slip)
            gross = p["way"] * (price - p["entry"]) * p["units"]
            cost = abs(price * p["units"]) * fee
            net = gross - p["paid"] - cost
            after = equity + gross - cost
            risk = p["units"] * abs(p["entry"] - p["stop"])
            out.append(("trade", p["signal"], p["i"], i, p["side"], p["entry"], price, p["stop"], p["target"], p["units"], why, gross, net, net / risk if risk else 0.0, after, p["regime"]))
            return after

        def enter(s: dict, i: int) -> dict | None:
            way = 1 if s["side"] == "LONG" else -1
            entry = open_[i] * (1 + way * slip)
            a = atr[int(s["i"])]
            reach = a * config.stop_atr if not np.isnan(a) and a > 0 else None
            stop = s.get("stop_price")
            stop = stop if not none(stop) else None if reach is None else entry - way * reach
            target = s.get("take_profit_price")
            target = target if not none(target) else None if stop is None else entry + (entry - stop) * config.reward_risk
            if stop is None or target is None or not way * stop < way * entry < way * target:
                return skip(s, i, "missing_or_invalid_risk_levels")
            risk = abs(entry - stop)
            if not (risk > 0 and equity > 0):
                return skip(s, i, "non_positive_position_risk")
            units = min(equity * config.risk_per_trade / risk, equity * config.max_leverage / entry)
            if not units > 0:
                return skip(s, i, "zero_position_size")
            return {"way": way, "side": s["side"], "signal": s["i"], "i": i, "entry": entry, "stop": stop, "target": target, "units": units, "paid": abs(entry * units) * fee, "regime": s.get("regime")}

        for i in range(n):
            had, due = held is not None, entries.get(i, [])
            if held and (hit := leaves(held, i)):
                equity, held = close_at(held, *hit[:1], i, hit[1]), None
            if due and had:
                for s in due:
                    skip(s, i, "position_open_at_entry")
            elif due:
                for s in due[1:]:
                    skip(s, i, "concurrent_signal")
                held = enter(due[0], i)
                if held:
                    equity -= held["paid"]
                    if hit := leaves(held, i):
                        equity, held = close_at(held, hit[0], i, hit[1]), None
            if held and i == n - 1:
                equity, held = close_at(held, close[i], i, "end_of_data"), None
            if curve:
                marked = equity + (held["way"] * (close[i] - held["entry"]) * held["units"] if held else 0.0)
                out.append(("equity", None, i, None, None, None, None, None, None, None, None, None, None, None, marked, None))
        return out

    return fold_two(bars.select(*KEY, "i", "open", "high", "low", "close", "atr"), found, kernel, BACKTEST_SCHEMA, ["i"])


def summary(results: DataFrame, config: BacktestConfig = BacktestConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Trades, wins, win rate, profit factor (null without losses) and net result.

    Of a curve, a row for each series, also one without trades, with the largest
    drawdown, the final equity and the return.
    """
    traded = F.col("row") == "trade"
    net = F.when(traded, F.col("net_pnl"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = results.where(traded if by else F.col("row").isin("trade", "equity")).groupBy(*KEY, *by)
    out = out.agg(F.count(net).alias("trades"), F.count(F.when(net > 0, 1)).alias("wins"), total(net).alias("net_pnl"), total(F.when(net > 0, net)).alias("gross_profit"), total(F.when(net < 0, -net)).alias("gross_loss"))
    factor = F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, F.lit(None)).otherwise(0.0)
    out = out.withColumn("losses", F.col("trades") - F.col("wins")).withColumn("win_rate", F.when(F.col("trades") > 0, F.col("wins") / F.col("trades")).otherwise(0.0)).withColumn("profit_factor", factor)
    if by:
        return out
    line = results.where("row = 'equity'")
    peak = F.greatest(F.max("equity").over(along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(config.initial_capital))
    drawn = line.withColumn("dd", (peak - F.col("equity")) / peak).groupBy(*KEY).agg(F.max("dd").alias("max_drawdown"), F.max_by("equity", "i").alias("final_equity"))
    return out.join(drawn.withColumn("return_pct", (F.col("final_equity") / config.initial_capital - 1) * 100), KEY, "left")
