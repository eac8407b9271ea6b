"""Liquidity, structure, strategy, profiles and models on literal fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import channels as H
from barwright.operators import features as X
from barwright.operators import learning as M
from barwright.operators import liquidity as L
from barwright.operators import profile as A
from barwright.operators import strategy as T
from barwright.operators import structure as S

from .helpers import bars, rows

LEVEL = "symbol string, tf int, i int, price double, type string, side string, confirmed_i int, scope string, scope_confirmed_i int"


def level(spark, at, closes, scope="internal", n_accept=3):
    """One high level at 110 (bar 0, known at bar 0), then bars of (high, close)."""
    table = bars(spark, [(110, 100, 105), *[(h, 90, c) for h, c in closes]])
    base = spark.createDataFrame([("X", 1, 0, 110.0, "BSL", "sh", 0, scope, 0)], LEVEL)
    (out,) = L.resolved(table, base, n_accept).collect()
    return out.swept_i, out.resolved_i, out.classification


@pytest.mark.parametrize(
    ("closes", "scope", "want"),
    [
        ([(112, 108)], "internal", (1, 1, "SWEEP")),
        ([(112, 111), (112, 109)], "internal", (1, 2, "GRAB")),
        ([(112, 111), (112, 109)], "external", (1, 2, "BIG_GRAB")),
        ([(112, 111), (113, 112), (113, 111)], "internal", (1, 3, "RUN")),
        ([(112, 111)], "internal", (1, None, None)),
        ([(109, 108), (110, 109)], "internal", (None, None, None)),
    ],
)
def test_how_levels_end(spark, closes, scope, want):
    assert level(spark, None, closes, scope) == want


def test_equal_levels(spark):
    highs = {1: 100.00, 5: 100.05, 9: 100.03}
    table = bars(spark, [(highs.get(i, 99.0), 90) for i in range(12)], atr=1.0)
    base = spark.createDataFrame([("X", 1, i, p, "BSL", "sh", i + 1, "internal", i + 1) for i, p in highs.items()], LEVEL)
    got = rows(L.equal_levels(base, table, tolerance=0.1), "i", "eq_pair", "eq_price")
    assert got == [(5, 1, pytest.approx(100.025)), (9, 5, pytest.approx(100.04))]
    assert rows(L.equal_levels(base, bars(spark, [(100.3 if i == 3 else highs.get(i, 99.0), 90) for i in range(12)], atr=1.0), tolerance=0.1), "i", "eq_pair") == [(9, 5)]
    seen = rows(L.with_equals(base, L.equal_levels(base, table, tolerance=0.1)), "i", "is_eqh", "eq_confirmed_i")
    assert seen == [(1, True, 6), (5, True, 6), (9, True, 10)]


def test_breaks(spark):
    closes = [10, 10, 12, 11, 8, 10, 7, 13]
    table = bars(spark, [(c + 1, c - 1, c) for c in closes])
    found = spark.createDataFrame([("X", 1, "high", 1, 11.0, 1), ("X", 1, "high", 3, 12.0, 3), ("X", 1, "low", 5, 9.0, 5), ("X", 1, "low", 3, 9.0, 3)], "symbol string, tf int, kind string, i int, price double, confirmed_i int")
    got = rows(S.breaks(table, found, "external"), "i", "type", "direction")
    assert got == [(2, "BOS", "bull"), (4, "CHOCH", "bear"), (6, "BOS", "bear"), (7, "CHOCH", "bull")]
    late = spark.createDataFrame([("X", 1, "high", 0, 10.0, 2)], "symbol string, tf int, kind string, i int, price double, confirmed_i int")
    assert rows(S.breaks(bars(spark, [(14, 8, c) for c in (9, 11, 12, 13)]), late, "external"), "i") == []


def test_gap_lifecycle(spark):
    table = bars(spark, [(101, 99, 100, 100), (106, 100, 105, 100), (107, 103, 106, 105), (106, 102, 104, 106), (105, 100, 101, 104)])
    zones = S.gaps(table)
    assert rows(zones, "i", "confirmed_i", "direction", "top", "bottom") == [(1, 2, "bull", 103, 101)]
    life = S.lifecycle(table, zones).collect()[0]
    assert (life.first_touch_i, life.end_i, life.fill_ratio, [tuple(f) for f in life.fills]) == (3, 4, 1.0, [(3, 0.5), (4, 1.0)])
    assert S.active_zones(S.lifecycle(table, zones), 3, 5).collect()[0].top == 102


def test_trailing(spark):
    table = bars(spark, [(10 if i != 10 else 12, 5 if i != 10 else 4) for i in range(12)])
    pivots = spark.createDataFrame([("X", 1, "high", 2, 11.0, 4), ("X", 1, "low", 3, 4.5, 5)], "symbol string, tf int, kind string, i int, price double, confirmed_i int")
    events = spark.createDataFrame([("X", 1, "BOS", "external", "bear", 9, 4.5, 3, 5, 0)], "symbol string, tf int, type string, scope string, direction string, i int, level double, pivot_i int, pivot_confirmed_i int, previous_trend int")
    got = S.trailing(table, pivots, events, 11).collect()[0]
    assert (got.top, got.top_i, got.bottom, got.bottom_i, got.bias, got.high_class, got.low_class) == (12, 10, 4, 10, "bearish", "strong_high", "weak_low")
    assert S.trailing(table, pivots, events, 8).collect()[0].top == 11


def test_signals(spark):
    main, other = [-1, -1, 1, 1, -1, 1], [-1, -1, -1, 1, -1, 1]
    ways = spark.createDataFrame([("X", 1, i, i * 60, a, b, 1) for i, (a, b) in enumerate(zip(main, other, strict=True))], "symbol string, tf int, i int, time long, supertrend int, halftrend int, range_filter int")
    config = T.SignalConfig(confirmations=("halftrend",), expiry=1)
    assert rows(T.signals(ways, config), "i", "side", "trigger_i") == [(3, "LONG", 2), (4, "SHORT", 4), (5, "LONG", 5)]


SIGNAL = "symbol string, tf int, i int, side string, stop_price double, take_profit_price double, regime string"


def test_backtest(spark):
    table = bars(spark, [(101, 99, 100, 100), (105, 99, 104, 100), (105, 100, 101, 104), (101, 99, 100, 100), (101, 95, 96, 100)])
    found = spark.createDataFrame([("X", 1, 0, "LONG", 98.0, 104.0, "up"), ("X", 1, 2, "SHORT", 102.0, 96.0, None), ("X", 1, 4, "LONG", 90.0, 120.0, None)], SIGNAL)
    out = T.backtest(table, found, curve=True)
    assert rows(out.where("row = 'trade'"), "i", "exit_i", "reason") == [(1, 1, "target"), (3, 4, "target")]
    assert rows(out.where("row = 'skipped'"), "signal_i", "reason") == [(4, "no_next_open")]
    assert out.where("row = 'trade'").agg(F.max("equity")).first()[0] == pytest.approx(10404.0)
    assert T.summary(out).first().win_rate == 1.0


def test_backtest_costs_and_collisions(spark):
    table = bars(spark, [(101, 99, 100, 100), (105, 99, 104, 100)])
    found = spark.createDataFrame([("X", 1, 0, "LONG", 98.0, 104.0, None)], SIGNAL)
    got = T.backtest(table, found, T.BacktestConfig(commission_bps=10, slippage_bps=10)).collect()[0]
    assert (got.entry_price, got.exit_price) == (pytest.approx(100.1), pytest.approx(103.896))
    wild = bars(spark, [(101, 99, 100, 100), (105, 97, 104, 100)])
    assert T.backtest(wild, found).collect()[0].reason == "stop"
    assert T.backtest(wild, found, T.BacktestConfig(target_first=True)).collect()[0].reason == "target"
    with pytest.raises(ValueError, match="positive"):
        T.BacktestConfig(risk_per_trade=0)


def test_profile_conserves_volume(spark):
    table = bars(spark, [(110, 90, 100, 95, 100), (105, 105, 105, 105, 900)]).withColumn("segment", F.lit(0))
    binned = A.bins(table, 20)
    assert binned.agg(F.sum("volume")).first()[0] == pytest.approx(1000)
    area = A.value_area(binned).first()
    assert abs(area.poc - 105) <= 0.5 and area.val <= area.poc <= area.vah
    flat = A.value_area(A.bins(bars(spark, [(100, 100, 100, 100, 50)]).withColumn("segment", F.lit(0)), 20)).first()
    assert (flat.poc, flat.total) == (100, 50)


def test_channel(spark):
    def table(break_at=None, **change):
        v = {"width": 5.0, "slope": 0.05, "count": 110} | change
        out = []
        for i in range(v["count"]):
            leg = min(i % 20, 20 - i % 20) / 10
            lower = 100 + i * v["slope"]
            close = lower + v["width"] * leg if i != break_at else lower - 5 * 0.55
            out.append((close + 0.05, close - 0.05, close, close))
        return bars(spark, out, atr=5.0)

    best = H.channels(table()).orderBy(F.desc("score")).first()
    assert best.direction == "bullish" and best.containment >= 0.85 and best.lower_touches >= 2 and best.upper_touches >= 2
    broken = H.channels(table(96)).orderBy(F.desc("score")).first()
    assert (broken.break_i, broken.break_direction) == (96, "down")
    assert H.channels(table(slope=0.0)).count() == 0 and H.channels(table(width=2.0)).count() == 0 and H.channels(table(count=65)).count() == 0


def test_labels(spark):
    events = spark.createDataFrame([("X", 1, k, t) for k, t in enumerate((1000, 1180, 1240, 1600))], "symbol string, tf int, event_i int, event_time long")
    end = spark.createDataFrame([("X", 1, 0, 2000)], "symbol string, tf int, i int, time long")
    got = rows(X.labels(events, end), "event_i", "Y_3m", "Y_5m", "Y_10m", "Y_15m", "complete")
    assert got[0] == (0, 1, 2, 3, 3, True) and got[1][1] == 1 and not got[3][5]


def test_constraints(spark):
    got = X.constrained(spark.createDataFrame([(4.0, -1.0, 12.0, 2.0)], "a double, b double, c double, d double"), ("a", "b", "c", "d")).first()
    assert tuple(got) == (3, 3, 10, 10)


def test_kmeans_and_mixture():
    rng = np.random.default_rng(3)
    centres = np.array([[0.01, 0.05, 0.01, 0.01, 1.0], [0.0, 0.0, 0.01, 0.01, 1.0], [0.0, 0.0, 0.2, 0.1, 2.0]])
    x = np.concatenate([c + rng.normal(0, 1e-3, (30, 5)) for c in centres])
    model = M.KMeans.fit(x)
    assert sorted(model.states) == ["RANGING", "TREND_BULLISH", "VOLATILE"]
    assert M.KMeans.fit(np.ones((40, 5))) is None
    mixture = M.GaussianMixture.fit(x, 3)
    own = mixture.probabilities(x)
    assert np.allclose(own.sum(axis=1), 1) and all(len(set(own.argmax(axis=1)[k : k + 30])) == 1 for k in (0, 30, 60))
    again = M.GaussianMixture.load(mixture.save())
    assert np.allclose(again.means, mixture.means)
    with pytest.raises(ValueError, match="distinct"):
        M.GaussianMixture.fit(np.ones((9, 2)), 3)


def test_markov_chain():
    chain = M.MarkovChain(["Healthy", "Fever"], np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]))
    emissions = M.MarkovChain.discrete([0, 1, 2], np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]]))
    assert [chain.states[k] for k in chain.viterbi(emissions)] == ["Healthy", "Healthy", "Fever"]
    assert np.allclose(chain.forward(emissions)[:2], chain.forward(emissions[:2]))


def test_lstm(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 6, 3))
    y = np.stack([x[:, -1, 0], x.mean(axis=(1, 2))], axis=1)
    model = M.Lstm(3, 8, 2, seed=1)
    _, g = model.gradients(x[:4], y[:4])
    model.p["u"][1, 5] += 1e-5
    up = model.gradients(x[:4], y[:4])[0]
    model.p["u"][1, 5] -= 2e-5
    down = model.gradients(x[:4], y[:4])[0]
    model.p["u"][1, 5] += 1e-5
    assert g["u"][1, 5] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)
    told = model.train(x, y, epochs=15, rate=1e-2)
    assert min(told["losses"]) < told["losses"][0]
    model.save(str(tmp_path / "m.npz"), ["a", "b", "c"])
    assert np.allclose(M.Lstm.load(str(tmp_path / "m.npz"), ["a", "b", "c"]).predict(x), model.predict(x))
    with pytest.raises(ValueError, match="columns"):
        M.Lstm.load(str(tmp_path / "m.npz"), ["a", "b", "d"])
