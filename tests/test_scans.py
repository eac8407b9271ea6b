"""First crossings, decaying averages and live views against loops over one series."""

from fractions import Fraction
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.functions import technical as K
from barwright.operators import liquidity as L
from barwright.operators import series as V
from barwright.operators import views as W
from barwright.operators.joins import first_beyond

from .helpers import SCHEMA, bars


@pytest.mark.parametrize("fan", [3, 1024])
def test_first_beyond_equals_a_scan(spark, fan):
    some = random.Random(fan)
    series = [(some.randint(20, 40), some.randint(0, 20)) for _ in range(130)]
    series[77] = (99, -50)
    asked = [("X", 1, k, some.randint(0, 129), float(some.choice([some.randint(15, 45), 98, 99])), some.choice([1, -1])) for k in range(60)] + [("X", 1, 60, 129, 0.0, 1), ("Z", 1, 61, 0, 0.0, 1)]
    got = first_beyond(spark.createDataFrame(asked, "symbol string, tf int, k int, a int, price double, way int"), bars(spark, series), after="a", price="price", way="way", to="hit", fan=fan)
    want = {k: next((i for i in range(a + 1, 130) if (series[i][0] > p if w > 0 else series[i][1] < p)), None) if s == "X" else None for s, _, k, a, p, w in asked}
    assert {r.k: r.hit for r in got.collect()} == want


def test_averages_over_stretches_equal_the_recurrence(spark):
    """One series of many stretches of both decays, and one shorter than the seed."""
    rng = np.random.default_rng(1)
    low = rng.uniform(50, 60, 3000)
    rows = bars(spark, list(zip(low + rng.uniform(0, 9, 3000), low, strict=True))).drop("atr", "atr_late").union(bars(spark, [(2, 1)] * 9, symbol="S").drop("atr", "atr_late")).withColumn("volume", F.col("high") * 3)
    want = {(r.symbol, r.i): r for r in V.indicators(rows).collect()}
    out = V.average_true_range(V.average_true_range(V.exponential_average(rows, "volume", 9, "e")), late=True, to="late").repartition(7)
    for r in out.collect():
        w = want[r.symbol, r.i]
        assert r.e == pytest.approx(w.ema_volume, abs=1e-9) and r.atr == (None if w.atr is None else pytest.approx(w.atr, abs=1e-9)) and r.late == (None if w.atr_late is None else pytest.approx(w.atr_late, abs=1e-9))
    with pytest.raises(ValueError, match="decay"):
        V.decayed(rows, F.lit(1.0), 1.5, "x")


def test_nearest_level_with_one_spike_of_atr(spark):
    """A bar whose atr reaches over all levels doesn't change what the others see."""
    rows = bars(spark, [(10 + k % 5, 8 + k % 3, 9 + k % 4) for k in range(60)], atr=[1000.0 if k == 30 else 1.0 for k in range(60)])
    levels = [("X", 1, 3 * k, float(8 + k % 7), "sh" if k % 2 else "sl", 3 * k + 3, "external" if k % 3 == 0 else "internal", 3 * k + 9 if k % 3 == 0 else 3 * k + 3, None if k % 4 else 3 * k + 20) for k in range(18)]
    found = spark.createDataFrame(levels, "symbol string, tf int, i int, price double, side string, confirmed_i int, scope string, scope_confirmed_i int, resolved_i int")
    got = {r.i: (r.internal_i, r.external_i) for r in L.nearest(rows, found).collect()}
    for b in rows.collect():
        best = {}
        for _, _, i, price, side, known, scope, turn, end in levels:
            if known <= b.i and (end is None or b.i < end):
                kind = "external" if scope == "external" and turn <= b.i else "internal"
                if abs(b.close - price) <= b.atr * (0.75 if kind == "external" else 0.5):
                    best[kind] = min(best.get(kind, (9e9,)), (abs(b.close - price), i, side != "sh"))
        assert got.get(b.i, (None, None)) == tuple(best[k][1] if k in best else None for k in ("internal", "external"))


def test_oscillators_and_earlier_hits(spark):
    closes = [float(x) for x in np.random.default_rng(4).uniform(5, 9, 60)]
    rows = spark.createDataFrame([("X", 1, i, 60 * i, c, c + 1, c - 1, c, 1.0, None, None) for i, c in enumerate(closes)], SCHEMA)
    up = down = None
    want = []
    for i in range(len(closes)):
        d = closes[i] - closes[i - 1] if i else 0
        if i == 14:
            steps = np.diff(closes[:15])
            up, down = np.maximum(steps, 0).mean(), np.maximum(-steps, 0).mean()
        elif i > 14:
            up, down = (up * 13 + max(d, 0)) / 14, (down * 13 + max(-d, 0)) / 14
        want.append(None if up is None else 100 - 100 / (1 + up / down))
    got = [r.rsi for r in K.with_rsi(rows).orderBy("i").collect()]
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got, want, strict=True))
    hits = [i for i, c in enumerate(closes) if c > 7]
    earlier = {r.i: r.v for r in K.with_value_when(rows, F.col("close") > 7, "close", 2, "v").collect()}
    assert all(earlier[i] == (closes[[h for h in hits if h <= i][-3]] if len([h for h in hits if h <= i]) > 2 else None) for i in range(60))


def test_missed_lines_and_line_points(spark):
    rows = bars(spark, [(10, 8), (12, 9), (14, 10), (11, 9), (9, 7), (8, 6)])
    missed = spark.createDataFrame([("X", 1, "missed", "high", 1, 12.0, 3), ("X", 1, "missed", "low", 0, 8.0, 3), ("X", 1, "missed", "low", 4, 7.0, 5), ("X", 1, "regular", "low", 2, 7.0, 2)], "symbol string, tf int, source string, kind string, i int, price double, confirmed_i int")
    got = {r.cursor: (r.anchor_i, r.pivot_type, r.vwap) for r in W.missed_lines(rows, missed).collect()}
    tp = [(h + lo + (h + lo) / 2) / 3 for h, lo in [(10, 8), (12, 9), (14, 10), (11, 9), (9, 7), (8, 6)]]
    assert got == {3: (1, "high", pytest.approx(np.mean(tp[1:4]))), 4: (1, "high", pytest.approx(np.mean(tp[1:5]))), 5: (4, "low", pytest.approx(np.mean(tp[4:6])))}
    line = spark.createDataFrame([("X", 1, 1, 4)], "symbol string, tf int, anchor_i int, cursor int")
    points = W.line_points(rows, line).orderBy("cursor").collect()
    assert [r.cursor for r in points] == [1, 2, 3, 4] and points[0].sigma == 0 and points[0].end_i == 4 and points[-1].vwap == pytest.approx(np.mean(tp[1:5]))


def exact_area(session, n=24):
    """poc, vah, val of (high, low, volume), prices in cents, in exact fractions."""
    lo, hi = min(low for _, low, _ in session), max(high for high, _, _ in session)
    place, volumes = lambda cents: Fraction((cents - lo) * n, hi - lo), [Fraction(0)] * n
    for high, low, volume in session:
        a, b = place(low), place(high)
        for k in range(min(int(a), n - 1), min(int(b), n - 1) + 1):
            volumes[k] += volume * max(min(b, k + 1) - max(a, k), 0) / (b - a) if b > a else volume
    first = last = poc = volumes.index(max(volumes))
    while sum(volumes[first : last + 1]) * 10 < sum(volumes) * 7:
        above, below = volumes[last + 1] if last + 1 < n else -1, volumes[first - 1] if first else -1
        first, last = (first, last + 1) if above >= below else (first - 1, last)
    return [pytest.approx(float(lo + Fraction(hi - lo, n) * k) / 100) for k in (poc + Fraction(1, 2), last + 1, first)]


def test_profiles_at_every_cursor_equal_exact_fractions(spark):
    """Bins equally full tie at any volume, and an area that holds just its share has it."""
    some = random.Random(3)
    sessions = [[(10031, 10012, 873397)], [(10087, 10069, 6454)], [(13299, 10024, 699842)], [(10205, 10195, 2), (11099, 10013, 8)], [(12195, 12195, 4), (10674, 10665, 4), (12721, 12705, 6), (11608, 11607, 9)]]
    for most in (10, 10000, 10**6) * 8:
        low = [some.randint(10000, 10300) for _ in range(5)]
        sessions.append([(x + some.choice([0, 19, some.randint(1, 3000)]), x, some.randint(1, most)) for x in low])
    table = bars(spark, [(h / 100, low / 100, h / 100, low / 100, v) for s in sessions for h, low, v in s])
    starts = [sum(map(len, sessions[:k])) for k in range(len(sessions))]
    table = table.withColumn("segment", sum(F.when(F.col("i") >= b, b - a).otherwise(0) for a, b in zip(starts, starts[1:], strict=False)))
    got = {(r.segment, r.cursor): [r.poc, r.vah, r.val] for r in W.profiles_at(table).collect()}
    for start, session in zip(starts, sessions, strict=True):
        for k in range(len(session)):
            if len({x for bar in session[: k + 1] for x in bar[:2]}) > 1:
                assert got[start, start + k] == exact_area(session[: k + 1]), session[: k + 1]


def test_nearest_rank_is_exact(spark):
    """Ranks that end on a half go up, for any number of scores: as doubles, those of 46, 86 and 166 went down."""
    sizes = [1, 2, 6, 16, 45, 46, 47, 86, 166, 176, 326]
    found = spark.createDataFrame([(f"s{n}", 1, i, float(i + 1)) for n in sizes for i in range(n)], "symbol string, tf int, i int, volume_score double")
    got = {r.symbol: r.least for r in L.weighted(found).groupBy("symbol").agg(F.min("i").alias("least")).collect()}
    assert got == {f"s{n}": ((n - 1) * 7 + 5) // 10 for n in sizes}
