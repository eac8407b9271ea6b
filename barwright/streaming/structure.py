"""Live swing pivots and sweeps: a stream of bars, or of changes to bars, gives what the batch operators give.

Each series keeps, between micro-batches, the bars that may still change, the
last 2 k + 1 closed ones and the open levels. A bar closes when one `delay`
seconds younger has been seen; bars that arrive in any order within the delay
are taken in order. A row for a bar that has closed comes too late: it changes
nothing and is counted.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUT = "symbol string, tf int, event string, kind string, i int, time long, price double, confirmed_i int, swept_i int, late int"


class Series:
    """One series' state: waiting bars by time, closed ones, open levels by price, and how many rows came too late."""

    def __init__(self, k: int, delay: int, held: dict | None = None):
        self.k, self.delay = k, delay
        held = held or {"waiting": {}, "recent": [], "above": [], "below": [], "closed": None, "newest": None, "n": 0, "late": 0}
        self.waiting = {int(t): bar for t, bar in held["waiting"].items()}
        self.recent, self.closed, self.newest, self.n, self.late = held["recent"], held["closed"], held["newest"], held["n"], held["late"]
        #: Levels over the price by rising, under it by falling price: (price, or its negative, i, time, confirmed_i).
        self.above, self.below = [tuple(x) for x in held["above"]], [tuple(x) for x in held["below"]]

    def dump(self) -> str:
        return json.dumps({"waiting": self.waiting, "recent": self.recent, "above": self.above, "below": self.below, "closed": self.closed, "newest": self.newest, "n": self.n, "late": self.late})

    def take(self, time: int, high: float, low: float, close: float, volume: float) -> bool:
        """A bar or a change to one: extremes widen, the last close holds, volumes add. False if it is too late."""
        if self.closed is not None and time <= self.closed:
            self.late += 1
            return False
        bar = self.waiting.get(time)
        self.waiting[time] = [high, low, close, volume] if bar is None else [max(bar[0], high), min(bar[1], low), close, bar[3] + volume]
        self.newest = time if self.newest is None else max(self.newest, time)
        return True

    def close(self) -> list[tuple]:
        """What the bars say that can't change any more: (event, kind, i, time, price, confirmed_i, swept_i)."""
        out: list[tuple] = []
        for time in sorted(t for t in self.waiting if t <= self.newest - self.delay):
            high, low, _, _ = self.waiting.pop(time)
            now, self.closed = self.n, time
            self.n += 1
            while self.above and self.above[0][0] < high:
                price, i, at, known = self.above.pop(0)
                out.append(("sweep", "high", i, at, price, known, now))
            while self.below and -self.below[0][0] > low:
                price, i, at, known = self.below.pop(0)
                out.append(("sweep", "low", i, at, -price, known, now))
            self.recent = [*self.recent[-2 * self.k :], [time, high, low]]
            if len(self.recent) == 2 * self.k + 1:
                at, top, bottom = self.recent[self.k]
                others = self.recent[: self.k] + self.recent[self.k + 1 :]
                if all(top > x[1] for x in others):
                    out.append(("pivot", "high", now - self.k, at, top, now, None))
                    bisect.insort(self.above, (top, now - self.k, at, now))
                if all(bottom < x[2] for x in others):
                    out.append(("pivot", "low", now - self.k, at, bottom, now, None))
                    bisect.insort(self.below, (-bottom, now - self.k, at, now))
        return out


def live_structure(bars: DataFrame, k: int = 3, delay: int = 600) -> DataFrame:
    """Events of a stream of bars or changes to bars (symbol, tf, time, high, low, close, volume), append mode.

    pivot: a swing high or low, with the bar that confirms it; sweep: the first
    later bar beyond a level, with that bar; late: how many rows of the batch
    came after their bar had closed. Bars are numbered from 0 by their time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series = Series(k, delay, json.loads(state.get[0]) if state.exists else None)
        late = 0
        for batch in batches:
            for r in batch.itertuples():
                late += not series.take(int(r.time), float(r.high), float(r.low), float(r.close), float(r.volume))
        rows = [(*key, *x, None) for x in (series.close() if series.newest is not None else [])]
        if late:
            rows.append((*key, "late", None, None, None, None, None, None, late))
        state.update((series.dump(),))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"i": "Int32", "time": "Int64", "confirmed_i": "Int32", "swept_i": "Int32", "late": "Int32"})

    return bars.select("symbol", "tf", "time", "high", "low", "close", "volume").groupBy("symbol", "tf").applyInPandasWithState(step, OUT, "held string", "append", "NoTimeout")
