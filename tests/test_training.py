"""Gradients summed over partitions against one process, and the path from rows to metrics."""

import numpy as np

from barwright.operators import training as R
from barwright.operators.learning import Lstm

ROWS = "row long, sequence array<array<double>>, target array<double>"


def some(n=90, steps=5, inputs=3):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, steps, inputs))
    return x, np.stack([x[:, -1, 0] - x[:, 0, 1], x.sum(axis=(1, 2)) / 4], axis=1)


def test_training_over_partitions_equals_one_process(spark):
    x, y = some()
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    many, one = spark.createDataFrame(rows, ROWS).repartition(7), spark.createDataFrame(rows, ROWS).coalesce(1)
    settings = dict(hidden=4, batches=2, epochs=3, rate=0.02, seed=1)
    model, report = R.fit(many, many, 3, 2, **settings)
    again, told = R.fit(one, one, 3, 2, **settings)
    assert len(report["losses"]) == 3 and np.allclose(report["losses"], told["losses"], atol=1e-9)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-9, rtol=0) for k in model.p)
    # a loop in this process over the same batches
    from pyspark.sql import functions as F

    alone, adam = Lstm(3, 4, 2, 1), None
    adam = R.Adam(alone.p, 0.02, 5.0)
    for epoch in (1, 2, 3):
        held = {r.row: r.b for r in one.select("row", F.pmod(F.xxhash64("row", F.lit(epoch), F.lit(1)), F.lit(2)).alias("b")).collect()}
        for batch in (0, 1):
            at = [k for k in range(len(x)) if held[k] == batch]
            adam.step(alone.p, alone.gradients(x[at], y[at])[1])
    if report["best_epoch"] == 3:
        assert all(np.allclose(model.p[k], alone.p[k], atol=1e-9, rtol=0) for k in model.p)
    assert report["losses"][-1] < report["losses"][0]


def test_path_from_rows_to_metrics_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    rows = [("X", 1, 60 * k, float(a), None if k % 9 == 0 else float(b), int(a > 0), int(a > 0) + 1) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    frame = spark.createDataFrame(rows, "symbol string, tf int, event_time long, a double, b double, Y_3m long, Y_5m long")
    out, metrics, report = R.evaluated(frame, ["a", "b"], ["Y_3m", "Y_5m"], length=3, limits=(3, 5), hidden=3, batches=1, epochs=2)
    got = out.collect()
    assert len(got) == 16 and all(0 <= r.p_Y_3m <= r.p_Y_5m <= 5 for r in got) and len(report["losses"]) == 2
    assert {(r.target, r.n) for r in metrics.collect()} == {("Y_3m", 16), ("Y_5m", 16)}
    none = spark.createDataFrame([], ROWS)
    model, told = R.fit(none, none, 3, 2, hidden=2, epochs=1, batches=1)
    assert told["losses"] == [0.0] and R.predict(none, model, ["p"] * 0).count() == 0
