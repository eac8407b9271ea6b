"""Live bars against batch bars."""

from pyspark.sql import functions as F

from barwright.operators import series as V
from barwright.sources.candles import candles, candles_from_events
from barwright.streaming import bars as live

DATA = "/root/testdata/sf0.001"


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_bars_equal_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "value", F.lit("ALL").alias("symbol"))
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    got = drain(live.live_bars(stream, 1440), "day_bars", "complete")
    want = candles(ticks, 1440)
    assert sorted(map(tuple, got.select("time", "open", "high", "low", "close", "volume").collect())) == sorted(map(tuple, want.select("time", "open", "high", "low", "close", "volume").collect()))


def test_live_atr_equals_batch(spark, tmp_path):
    bars = candles_from_events(spark, DATA, 60)
    bars.repartition(1).sortWithinPartitions("time").write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    got = drain(live.live_atr(stream), "live_atr", "append")
    key = lambda r: (r.symbol, r.time)
    live_rows = {key(r): r.atr for r in got.collect()}
    batch = {key(r): r.atr for r in V.indicators(bars).collect()}
    assert live_rows == batch


def test_live_structure_equals_batch_over_shuffled_batches(spark, tmp_path):
    """Bars arrive in small files, out of order within the delay, some in two parts; a few far too late."""
    import random

    from barwright.operators import liquidity as L
    from barwright.operators import pivots as P
    from barwright.streaming.structure import live_structure

    some = random.Random(3)
    bars = candles_from_events(spark, DATA, 60).select("symbol", "tf", "i", "time", "open", "high", "low", "close", "volume").where("i < 90")
    rows = sorted((r for r in bars.collect() if r.symbol in ("click", "view")), key=lambda r: (r.time, r.symbol))
    last = {s: max(r.time for r in rows if r.symbol == s) for s in ("click", "view")}
    sent = []
    for r in rows:
        at = r.time + some.randint(0, 7000)
        halves = [(r.symbol, r.tf, r.time, r.high, (r.high + r.low) / 2, r.close, 0.5), (r.symbol, r.tf, r.time, r.high, r.low, r.close, r.volume - 0.5)] if some.random() < 0.3 else [(r.symbol, r.tf, r.time, r.high, r.low, r.close, r.volume)]
        sent += [(at, x) for x in halves]
    sent = [x for _, x in sorted(sent, key=lambda x: x[0])]
    sent += [(s, 60, t + 10 * 7200, 0.0, 1e9, 0.0, 1.0) for s, t in last.items()]  # closes all that came before
    sent += [("click", 60, rows[0].time, 1e9, -1e9, 0.0, 1.0)] * 3
    schema = "symbol string, tf int, time long, high double, low double, close double, volume double"
    for k, at in enumerate(range(0, len(sent), 40)):
        spark.createDataFrame(sent[at : at + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drain(live_structure(stream, 3, 7200), "live_structure", "append").collect()
    batch = bars.where("symbol in ('click', 'view')")
    pivots = {(r.symbol, r.kind, r.i, r.time, r.price, r.confirmed_i) for r in P.pivots(batch, 3).collect()}
    sweeps = {(r.symbol, "high" if r.side == "sh" else "low", r.i, r.price, r.confirmed_i, r.swept_i) for r in L.levels(batch).collect() if r.swept_i is not None}
    assert {(r.symbol, r.kind, r.i, r.time, r.price, r.confirmed_i) for r in got if r.event == "pivot" and r.confirmed_i < 90} == pivots and pivots
    assert {(r.symbol, r.kind, r.i, r.price, r.confirmed_i, r.swept_i) for r in got if r.event == "sweep" and r.swept_i < 90} == sweeps and sweeps
    assert sum(r.late for r in got if r.event == "late") == 3
