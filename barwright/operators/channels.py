"""Trend channels: parallel lines through confirmed pivots that hold the closes between them.

Candidates of a series come from its last `lookback` base pivots and the
opposite pivots, so their number is bounded by the parameter and the pivots of
the series; each is judged on arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .core import KEY, fold, fold_two
from .pivots import pivots


@dataclass(frozen=True)
class ChannelConfig:
    pivot_bars: int = 3
    minimum_minutes: float = 60
    minimum_bars: int = 8
    contact: float = 0.15
    breakout: float = 0.25
    strong_breakout: float = 0.40
    merge_bars: int = 3
    merge_minutes: float = 10
    main_touches: int = 2
    opposite_touches: int = 2
    total_touches: int = 4
    containment: float = 0.85
    width: tuple[float, float] = (0.75, 8.0)
    minimum_move: float = 0.50
    lookback: int = 20
    minimum_score: float = 0.70
    most: int = 3


SCHEMA = "direction string, start_i int, end_i int, confirmed_i int, slope double, lower_start double, lower_end double, upper_start double, upper_end double, width double, width_in_atr double, containment double, lower_touches int, upper_touches int, touch_spread double, score double, minutes double, break_i int, break_direction string"


class _Judge:
    """One series' arrays and the tests of a candidate."""

    def __init__(self, b: dict[str, np.ndarray], c: ChannelConfig):
        self.b, self.c, self.n = b, c, len(b["i"])
        atr = np.nan_to_num(b["atr"].astype(float))
        self.atr = np.where(atr > 0, atr, 0.0)
        self.sums = np.concatenate([[0.0], np.cumsum(self.atr)])
        self.counts = np.concatenate([[0], np.cumsum(self.atr > 0)])

    def mean_atr(self, lo: int, hi: int) -> float:
        n = self.counts[hi + 1] - self.counts[lo] if hi >= lo else 0
        return float((self.sums[hi + 1] - self.sums[lo]) / n) if n else 0.0

    def lines(self, a: dict, slope: float, offset: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = a["price"] + slope * (at - a["i"])
        return np.minimum(base, base + offset), np.maximum(base, base + offset)

    def first_break(self, a: dict, slope: float, offset: float, lo: int, hi: int) -> tuple[int, str] | None:
        """The first close far outside, or the second in a row outside on one side."""
        at = np.arange(lo, hi + 1)
        at = at[self.atr[at] > 0]  # bars without a range neither break nor end a run
        low, high = self.lines(a, slope, offset, at)
        close, atr = self.b["close"][at], self.atr[at]
        side = np.where(close > high + atr * self.c.breakout, 1, np.where(close < low - atr * self.c.breakout, -1, 0))
        strong = (close > high + atr * self.c.strong_breakout) | (close < low - atr * self.c.strong_breakout)
        second = np.concatenate([[False], (side[1:] == side[:-1]) & (side[1:] != 0)])[: len(at)]
        hit = np.flatnonzero(strong | second)
        return (int(at[hit[0]]), "up" if side[hit[0]] > 0 else "down") if len(hit) else None

    def contacts(self, at: np.ndarray) -> list[int]:
        """Bars that touch a line; a touch soon after another takes its place."""
        out: list[int] = []
        time = self.b["time"]
        for i in at.tolist():
            if out and (i - out[-1] < self.c.merge_bars or (time[i] - time[out[-1]]) / 60 < self.c.merge_minutes):
                out[-1] = i
            else:
                out.append(i)
        return out

    def candidate(self, up: bool, a: dict, b: dict, o: dict) -> tuple | None:
        c, time = self.c, self.b["time"]
        slope = (b["price"] - a["price"]) / (b["i"] - a["i"])
        offset = o["price"] - (a["price"] + slope * (o["i"] - a["i"]))
        if (offset <= 0) if up else (offset >= 0):
            return None
        fits = lambda atr: atr > 0 and c.width[0] <= abs(offset) / atr <= c.width[1]
        known, last = max(a["confirmed_i"], b["confirmed_i"], o["confirmed_i"]), max(b["i"], o["i"])
        if not fits(self.mean_atr(a["i"], o["i"])) or known > self.n - 1:
            return None
        early = self.first_break(a, slope, offset, a["i"] + 1, known)
        if early and early[0] < last:
            return None
        broken = self.first_break(a, slope, offset, known + 1, self.n - 1)
        end = broken[0] if broken else self.n - 1
        seconds = time[end] - time[a["i"]]
        if end < last or seconds < c.minimum_minutes * 60 or end - a["i"] + 1 < c.minimum_bars:
            return None
        mean = self.mean_atr(a["i"], end)
        if not fits(mean):
            return None
        at = np.arange(a["i"], end + 1)
        low, high = self.lines(a, slope, offset, at)
        near = self.atr[at] * c.contact
        upper = self.contacts(at[np.abs(self.b["high"][at] - high) <= near])
        lower = self.contacts(at[np.abs(self.b["low"][at] - low) <= near])
        main, other = (lower, upper) if up else (upper, lower)
        if len(main) < c.main_touches or len(other) < c.opposite_touches or len(main) + len(other) < c.total_touches:
            return None
        close = self.b["close"][at]
        inside = float(((close >= low - near) & (close <= high + near)).mean())
        if inside < c.containment:
            return None
        both = sorted(upper + lower)
        spread = min(1.0, max(0.0, (both[-1] - both[0]) / (end - a["i"])))
        touch = min(1.0, len(both) / c.total_touches) * (0.75 + 0.25 * spread)
        middle, width = sum(c.width) / 2, abs(offset) / mean
        score = 0.35 * touch + 0.35 * inside + 0.15 * min(1.0, seconds / (c.minimum_minutes * 120)) + 0.15 * (1 - min(1.0, abs(width - middle) / max(0.001, middle)))
        if score < c.minimum_score:
            return None
        return ("bullish" if up else "bearish", a["i"], end, known, slope, low[0], low[-1], high[0], high[-1], abs(offset), round(width, 4), round(inside, 4), len(lower), len(upper), round(spread, 4), round(score, 4), round(seconds / 60, 2), broken and broken[0], broken and broken[1])


def _same(x: tuple, y: tuple) -> bool:
    if x[0] != y[0]:
        return False
    lo, hi = max(x[1], y[1]), min(x[2], y[2])
    if hi <= lo or (hi - lo) / min(max(1, x[2] - x[1]), max(1, y[2] - y[1])) < 0.70:
        return False
    if abs(x[4] - y[4]) / max(1e-6, abs(x[4]), abs(y[4])) > 0.18:
        return False
    return abs(x[9] - y[9]) / max(1e-6, x[9], y[9]) <= 0.30


def channels(bars: DataFrame, config: ChannelConfig = ChannelConfig()) -> DataFrame:
    """The best channels of each series (bars need column atr), at most `most` that are not alike."""

    def kernel(b: dict[str, np.ndarray], found: list[dict]) -> list[tuple]:
        judge, out = _Judge(b, config), []
        if judge.n < config.minimum_bars or b["time"][-1] - b["time"][0] < config.minimum_minutes * 60:
            return []
        both = {f["i"] for f in found if f["kind"] == "low"} & {f["i"] for f in found if f["kind"] == "high"}
        found = [f for f in found if f["i"] not in both]
        for up, kind in ((True, "low"), (False, "high")):
            base = [f for f in found if f["kind"] == kind][-config.lookback :]
            opposite = [f for f in found if f["kind"] != kind]
            for x, a in enumerate(base):
                for z in base[x + 1 :]:
                    move = z["price"] - a["price"]
                    mean = judge.mean_atr(a["i"], z["i"])
                    if (move > 0) != up or not move or mean <= 0 or abs(move) < mean * config.minimum_move:
                        continue
                    out += [r for o in opposite if o["i"] >= a["i"] and (r := judge.candidate(up, a, z, o))]
        out.sort(key=lambda r: (-r[15], -r[2], -r[3], r[1]))
        best: list[tuple] = []
        for r in out:
            if not any(_same(k, r) for k in best):
                best.append(r)
            if len(best) == config.most:
                break
        return best

    found = pivots(bars, config.pivot_bars)
    return fold_two(bars.select(*KEY, "i", "time", "high", "low", "close", "atr"), found.select(*KEY, "kind", "i", "price", "confirmed_i"), kernel, SCHEMA, ["i", "kind"])


THREE_SCHEMA = "base_i int, middle_i int, last_i int, base_price double, slope double, width double, confirmed_i int, break_i int, minutes double"


def three_low_channels(bars: DataFrame, found: DataFrame, *, reach: int = 30, tries: int = 3, atr_share: float = 0.005, minutes: float = 120) -> DataFrame:
    """Channels over three lows in line, known with the last of them, and the first close outside (break_i).

    For each low, the nearest earlier lows at least two hours back are tried as
    the first, the middle one being the low between them that lies nearest to
    the line.
    """

    def kernel(b: dict[str, np.ndarray], rows: list[dict]) -> list[tuple]:
        time, high, low, close, n = b["time"], b["high"], b["low"], b["close"], len(b["i"])
        atr = b["atr"].astype(float)
        good = np.nan_to_num(atr) > 0
        total, count = np.concatenate([[0.0], np.cumsum(np.where(good, atr, 0.0))]), np.concatenate([[0], np.cumsum(good)])
        lows = [r for r in rows if r["kind"] == "low"]

        def judged(a: dict, m: dict, c: dict) -> tuple | None:
            end = c["confirmed_i"]
            k = count[end + 1] - count[a["i"]]
            if not k:
                return None
            mean = (total[end + 1] - total[a["i"]]) / k
            slope = (c["price"] - a["price"]) / (c["i"] - a["i"])
            line = lambda at: a["price"] + slope * (at - a["i"])
            price = (a["price"] + m["price"] + c["price"]) / 3
            if abs(m["price"] - line(m["i"])) > 0.25 * mean or price == 0 or mean / abs(price) > atr_share:
                return None
            at = np.arange(a["i"], end + 1)
            width = float((high[at] - line(at)).max())
            if not 0.75 * mean < width < 8 * mean:
                return None
            room = 0.25 * np.where(np.isnan(atr), mean, atr)
            if ((low[at] >= line(at) - room[at]) & (high[at] <= line(at) + width + room[at])).mean() < 0.85:
                return None
            later = np.arange(end + 1, n)
            out = np.flatnonzero((close[later] < line(later) - room[later]) | (close[later] > line(later) + width + room[later]))
            return (a["i"], m["i"], c["i"], a["price"], slope, width, end, int(later[out[0]]) if len(out) else None, (time[c["i"]] - time[a["i"]]) / 60)

        out = []
        for z in range(2, len(lows)):
            c, tried = lows[z], 0
            for x in range(z - 2, max(0, z - reach) - 1, -1):
                a = lows[x]
                if time[c["i"]] - time[a["i"]] < minutes * 60:
                    continue
                tried += 1
                if tried > tries:
                    break
                lo, hi = sorted((a["price"], c["price"]))
                between = [m for m in lows[x + 1 : z] if lo < m["price"] < hi]
                if not between:
                    continue
                slope = (c["price"] - a["price"]) / (c["i"] - a["i"])
                m = min(between, key=lambda m: abs(m["price"] - a["price"] - slope * (m["i"] - a["i"])))
                if r := judged(a, m, c):
                    out.append(r)
                    break
        return out

    return fold_two(bars.select(*KEY, "i", "time", "high", "low", "close", "atr"), found.select(*KEY, "kind", "i", "price", "confirmed_i"), kernel, THREE_SCHEMA, ["confirmed_i", "i"])


def parallel_stop(bars: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """Parabolic stop and reverse of each bar."""

    def kernel(b: dict[str, np.ndarray]) -> dict:
        high, low, n = b["high"], b["low"], len(b["i"])
        out, way = np.empty(n), np.ones(n, int)
        side, stop, best, gain = 1, low[0], high[0], start
        for i in range(n):
            if i:
                stop += gain * (best - stop)
                stop = min(stop, *low[max(0, i - 2) : i]) if side > 0 else max(stop, *high[max(0, i - 2) : i])
                if (low[i] < stop) if side > 0 else (high[i] > stop):
                    side, stop, best, gain = -side, best, low[i] if side > 0 else high[i], start
                elif (high[i] > best) if side > 0 else (low[i] < best):
                    best, gain = (high[i] if side > 0 else low[i]), min(most, gain + step)
            out[i], way[i] = stop, side
        return {"i": b["i"], "sar": out, "sar_direction": way}

    return fold(bars.select(*KEY, "i", "high", "low"), kernel, "i int, sar double, sar_direction int")
