"""Tables from literal fixtures."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("time", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "atr", "atr_late")])


def bars(spark, rows, tf=1, step=60, start=0, atr=None, symbol="X"):
    """rows: (high, low), (high, low, close) or (high, low, close, open[, volume])."""
    out = []
    for i, r in enumerate(rows):
        high, low = r[0], r[1]
        close = r[2] if len(r) > 2 else (high + low) / 2
        open_ = r[3] if len(r) > 3 else close
        volume = r[4] if len(r) > 4 else 1.0
        a = atr[i] if isinstance(atr, list) else atr
        out.append((symbol, tf, i, start + i * step, float(open_), float(high), float(low), float(close), float(volume), None if a is None else float(a), None if a is None else float(a)))
    return spark.createDataFrame(out, SCHEMA)


def rows(df, *columns, order=None):
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: tuple((x is None, x) for x in r)) if order is None else got
