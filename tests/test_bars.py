"""Sources, resampling, averages and levels on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from barwright.operators import bars as B
from barwright.operators import levels as Z
from barwright.operators import series as V
from barwright.sources import candles as C

from .helpers import bars, rows


def test_resample(spark):
    at = bars(spark, [(101 + k, 99 + k, 100.5 + k, 100 + k, 10 + k) for k in range(10)], start=1_800_000_000)
    five = rows(B.resample(at, 5), "time", "open", "high", "low", "close", "volume")
    assert five[0] == (1_800_000_000, 100, 105, 99, 104.5, 60) and len(five) == 2
    counts = {r.tf: r["count"] for r in B.resample_many(at).groupBy("tf").count().collect()}
    assert counts[15] == counts[1440] == counts[10080] == 1


def test_week_starts_on_thursday(spark):
    at = bars(spark, [(2, 1)], start=1782864000)  # 2026-07-01
    assert rows(B.resample(at, 10080), "time") == [(1782345600,)]  # Thursday 2026-06-25


def test_upsert(spark):
    deltas = spark.createDataFrame([("X", 1, 60, 109.0, 110.0, 108.0, 109.5, 19.0, 1), ("X", 1, 60, 109.0, 115.0, 106.0, 114.0, 7.0, 2)], "symbol string, tf int, time long, open double, high double, low double, close double, volume double, seq int")
    assert rows(C.upsert(deltas), "i", "high", "low", "close", "volume") == [(0, 115, 106, 114, 26)]


def test_atr(spark):
    at = bars(spark, [(10, 8, 9), (12, 9, 11), (13, 10, 12), (14, 11, 13)])
    out = rows(V.indicators(at, atr_period=2), "i", "atr", "atr_late")
    assert [r[1] for r in out] == [None, 2.5, 2.75, 2.875]
    assert [r[2] for r in out] == [None, None, 3.0, 3.0]


def test_atr_is_known_as_of_each_prefix(spark):
    at = bars(spark, [(10 + (7 * k) % 5, 8 - (3 * k) % 4, 9) for k in range(40)])
    whole = {r.i: r.asDict() for r in V.indicators(at).collect()}
    for r in V.indicators(B.prefix(at, 25)).collect():
        assert r.asDict() == whole[r.i]


@pytest.mark.parametrize(("change", "problem"), [("time = 0", "duplicate time"), ("time = -5", "disorder"), ("high = 0", "inconsistent prices"), ("volume = -1", "negative volume"), ("close = cast('NaN' as double)", "not finite")])
def test_bad_rows_are_refused(spark, change, problem):
    at = bars(spark, [(2, 1), (2, 1), (3, 1)])
    column, value = change.split(" = ")
    bad = at.withColumn(column, F.when(F.col("i") == 1, F.expr(value)).otherwise(F.col(column)))
    with pytest.raises(ValueError, match=problem):
        C.check(bad, "i")


def test_csv(spark, tmp_path):
    file = tmp_path / "bars.csv"
    file.write_text("Time,Open,High,Low,Close,Volume\r\n2026-07-01T09:30:00-05:00,1,3,1,2,5\r\n\r\n2026-07-01T09:31:00-05:00,2,4,2,3,6\r\n")
    got = C.read_strict_csv(spark, str(file), "X").orderBy("i").collect()
    assert [(r.i, r.time, r.tz_offset, r.date, r.hour, r.minute, r.close) for r in got] == [(0, 1782916200, -18000, "2026-07-01", 9, 30, 2.0), (1, 1782916260, -18000, "2026-07-01", 9, 31, 3.0)]
    assert [r.time for r in C.read_chart_csv(spark, str(file), "X").orderBy("i").collect()] == [1782916200, 1782916260]
    file.write_text("time,open,high,low,volume\n")
    with pytest.raises(ValueError, match="close"):
        C.read_strict_csv(spark, str(file), "X")
    file.write_text("time,open,high,low,close,volume\nnot a time,1,1,1,1,1\n")
    with pytest.raises(ValueError, match="timestamp"):
        C.read_strict_csv(spark, str(file), "X")


def test_epoch_seconds(spark):
    got = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2023-11-14T22:13:20Z",), ("x",)], "t string").select(C.epoch_seconds(F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == [1_700_000_000] * 3 + [None]


def test_previous_day_and_week(spark):
    day = 86400
    monday = 1782691200  # Monday 2026-06-29 00:00 UTC
    data = [(monday - 2 * day, 120, 85), (monday, 100, 92), (monday + day, 110, 90), (monday + day + 60, 105, 95), (monday + 2 * day, 101, 99)]
    at = spark.createDataFrame([("X", 1, i, t, 1.0, float(h), float(l), 1.0, 1.0) for i, (t, h, l) in enumerate(data)], "symbol string, tf int, i int, time long, open double, high double, low double, close double, volume double")
    days = rows(Z.previous_high_low(at, "D"), "available_i", "type", "price", "anchor_i")
    assert (4, "PDH", 110, 2) in days and (4, "PDL", 90, 2) in days
    assert rows(Z.previous_high_low(at, "W"), "available_i", "type", "price") == [(1, "PWH", 120), (1, "PWL", 85)]
    seen = rows(Z.levels_at(Z.previous_high_low(at, "D"), at), "i", "pdh_price")
    assert seen == [(0, None), (1, 120), (2, 100), (3, 100), (4, 110)]


def test_zone_levels(spark):
    zigzag = spark.createDataFrame([("X", 1, "low", 0, 100.0, 0), ("X", 1, "high", 5, 110.0, 5), ("X", 1, "low", 9, 100.0, 9), ("X", 1, "high", 14, 120.0, 14)], "symbol string, tf int, kind string, i int, price double, confirmed_i int")
    got = rows(Z.zone_levels(zigzag, 20), "index", "rounded_price")
    assert got[0] == (0, pytest.approx(106.18)) and len(got) == 8
    short = rows(Z.zone_levels(zigzag.where("i < 14").unionByName(zigzag.limit(1).selectExpr("symbol", "tf", "'high' kind", "14 i", "105.0D price", "14 confirmed_i")), 20), "ratio")
    assert short == [(0.618,), (0.786,), (1.0,)]


def test_features_are_written_as_named(spark, tmp_path):
    from barwright.sources.candles import predictions, write_features

    rows = spark.createDataFrame([(1, 'a "b", c', 1 / 3, None, 2), (2, None, 1e20, 0.5, None)], "t long, name string, x double, y double, z int")
    write_features(rows.coalesce(1), str(tmp_path / "f"), ["t", "name"], ["y", "x"], ["z"])
    text = next((tmp_path / "f").glob("part-*")).read_text()
    assert text == 't,name,y,x,z\n1,"a ""b"", c",,0.3333333333,2\n2,,0.5,1e+20,\n'
    out = predictions(rows, ["x"], ["z"], ["t"])
    assert out.columns == ["t", "actual_x", "prediction_x", "residual_x"] and out.first().residual_x == 1 / 3 - 2
