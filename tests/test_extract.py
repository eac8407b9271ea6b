"""The feature extract: its columns, what a prefix of the bars knows, and the sweep for the nearest open span."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barwright.operators import extract as E
from barwright.operators import profile as A
from barwright.operators.joins import nearest_open

from .helpers import bars

BARS = "symbol string, tf int, i int, time long, open double, high double, low double, close double, volume double"


def wave(n):
    out = []
    for i in range(n):
        close = 20_000 + math.sin(i / 4) * 8 + math.sin(i / 17) * 3 + i * 0.01
        open_ = close + math.sin(i) * 0.4
        out.append(("X", 1, i, 1_780_000_000 // 60 * 60 + i * 60, open_, max(open_, close) + 1.5 + (i % 3) * 0.1, min(open_, close) - 1.5 - (i % 2) * 0.1, close, 100.0 + i % 20))
    return out


def test_columns():
    features = E.feature_columns()
    assert len(features) == 64 == len(set(features)) and len(E.METADATA) == 8 and E.target_columns() == ["Y_3m", "Y_5m", "Y_10m", "Y_15m"]
    assert not {"event_date", "event_hour", "event_minute", "event_timestamp"} & set(features)
    assert {f"tf{tf}_{n}_dist_pips" for tf in (1, 10, 60) for n in ("ob", "fvg", "fib", "vwap", "vp_poc", "bos_choch", "eqh_eql", "sweep_grab_run", "supply_demand", "channel")} <= set(features)


def test_a_prefix_of_the_bars_gives_the_same_rows(spark):
    whole = spark.createDataFrame(wave(360), BARS)
    made = {n: {r.event_id: r.asDict() for r in E.extract(whole.where(F.col("i") < n), ghost_length=2, external_k=4, offset=-5 * 3600).collect()} for n in (240, 360)}
    assert len(made[240]) > 10 and len(made[360]) > len(made[240])
    for key, row in made[240].items():
        assert {k: v for k, v in row.items() if v != made[360][key][k]} == {}
    by_time = {t: (h, lo, c) for _, _, _, t, _, h, lo, c, _ in wave(360)}
    for r in made[360].values():
        h, lo, c = by_time[wave(360)[r["ghost_index"]][3]]
        assert r["ghost_hlc3"] == pytest.approx((h + lo + c) / 3) and r["ghost_index"] <= r["event_index"] and r["complete"]
        assert r["Y_3m"] <= r["Y_5m"] <= r["Y_10m"] <= r["Y_15m"] and r["atr_1m"] is not None
    everything = E.extract(whole, ghost_length=2, external_k=4, include_incomplete=True)
    assert everything.where("not complete").count() > 0 and everything.where("complete").count() == len(made[360])


@pytest.mark.parametrize(("seed", "chunk"), [(1, 4096), (2, 7)])
def test_nearest_open_equals_a_look_at_all(spark, seed, chunk):
    some = random.Random(seed)
    spans = [("X", 1, some.choice("ab"), float(some.randint(0, 20)), float(some.randint(0, 3)), float(some.randint(0, 2)), f, some.choice([None, f - 1, f, f + some.randint(0, 40)])) for f in (some.randint(0, 60) for _ in range(80))]
    points = [("X", 1, p, some.randint(0, 60), some.randint(0, 40) / 2) for p in range(60)] + [("Y", 1, 0, 5, 1.0)]
    got = nearest_open(spark.createDataFrame(points, "symbol string, tf int, p int, cursor int, ref double"), spark.createDataFrame(spans, "symbol string, tf int, kind string, value double, tie double, width double, first int, last int"), point="p", at="cursor", ref="ref", chunk=chunk)
    want = {}
    for s, _, p, at, ref in points:
        for kind in "ab":
            seen = [(abs(v - ref), -tie, v, w) for x, _, k, v, tie, w, a, b in spans if x == s and k == kind and a <= at and (b is None or at <= b)]
            if seen:
                want[s, p, kind] = min(seen)[:2]
    assert {(r.symbol, r.p, r.kind): (abs(r.value - next(x[4] for x in points if x[0] == r.symbol and x[2] == r.p)), -r.tie) for r in got.collect()} == want


def test_range_profile_of_overlapping_spans_and_of_a_flat_one(spark):
    rows = bars(spark, [(10, 8), (12, 9), (9, 9), (9, 9), (11, 7)])
    got = {(r["first"], r["last"]): r for r in A.range_profile(rows, spark.createDataFrame([("X", 1, 0, 1), ("X", 1, 0, 4), ("X", 1, 2, 3)], "symbol string, tf int, first int, last int"), 4).collect()}
    assert (got[2, 3].poc, got[2, 3].vah, got[2, 3].val) == (9.0, 9.0, 9.0)
    assert got[0, 1].val == 8.0 and got[0, 4].total == 5.0 and set(got) == {(0, 1), (0, 4), (2, 3)}
