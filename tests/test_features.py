"""Zones that a point in time sees, and models that it knows."""

from barwright.operators import features as X
from barwright.operators import learning as M
from barwright.plans import catalog


def test_open_zones_of_any_age(spark):
    zones = [(0, None), (10, 700), (100, None), (590, 1300), (880, 881), (950, None)]
    points = [0, 500, 600, 601, 699, 700, 881, 1200, 1299, 1300]
    at = spark.createDataFrame([("X", 60, i) for i in points], "symbol string, tf int, cursor int")
    z = spark.createDataFrame([("X", 60, c, e) for c, e in zones], "symbol string, tf int, confirmed_i int, end_i int")
    for lookback in (None, 500):
        got = sorted((r.cursor, r.confirmed_i) for r in X.active(at, z, "cursor", lookback).collect())
        assert got == sorted((i, c) for i in points for c, e in zones if c <= i and (e is None or i < e) and (lookback is None or i <= c + lookback))
    old = X.active(at.where("cursor = 1200"), z.where("confirmed_i = 0"), "cursor")
    assert old.count() == 1


def test_walk_forward_fits_for_every_bar(spark):
    data = "/root/testdata/sf0.001"
    out = catalog.QUERIES["c8_walk_forward"](spark, data).collect()
    assert len(out) > 100 and all(r.trained_through == r.i - 1 for r in out)
    symbol = out[0].symbol
    last = max((r for r in out if r.symbol == symbol), key=lambda r: r.i)
    # one split just before the last bar is the same fit
    n = last.i + 1
    rows = catalog.features(spark, data).where(f"symbol = '{symbol}'")
    alone = M.regimes(rows, method="gmm_hmm", share=last.i / n + 1e-9).where(f"i = {last.i}").first()
    # the catalog rounds to six digits
    assert alone.state == last.state and abs(alone.confidence - last.confidence) < 1e-6
