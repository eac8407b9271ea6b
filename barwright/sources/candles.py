"""Reading, validating and writing bars.

A bar table has symbol, tf (minutes), i (0-based ordinal of the series), time
(epoch seconds, UTC) and open, high, low, close, volume.
"""

from __future__ import annotations

from collections.abc import Sequence
import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def with_index(bars: DataFrame) -> DataFrame:
    """i: the ordinal of a bar in its series."""
    return bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("time")) - 1)


def iso_parts(text: Column) -> dict[str, Column]:
    """time, tz_offset (seconds), date, hour and minute (local) of an ISO-8601 text with an offset; null if it isn't one."""
    part = lambda k: F.regexp_extract(text, ISO, k)
    zone = F.regexp_replace(part(5), ":", "")
    seconds = F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60
    offset = F.when(zone == "Z", 0).when(F.substring(zone, 1, 1) == "-", -seconds).otherwise(seconds)
    ok = text.rlike(ISO)
    day = F.expr("unix_date(date'1970-01-01')") * 0 + F.datediff(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd")), F.lit("1970-01-01").cast("date"))
    local = day.cast("long") * 86400 + part(2).cast("int") * 3600 + part(3).cast("int") * 60 + part(4).cast("int")
    values = {"time": local - offset, "tz_offset": offset, "date": part(1), "hour": part(2).cast("int"), "minute": part(3).cast("int")}
    return {k: F.when(ok, v) for k, v in values.items()}


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds of seconds, milliseconds (from 1e11 on) or ISO text."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(number.isNotNull(), F.floor(F.when(F.abs(number) >= 1e11, number / 1000).otherwise(number))).otherwise(iso_parts(value.cast("string"))["time"])


def read_chart_csv(spark: SparkSession, path: str, symbol: str, tf: int = 1) -> DataFrame:
    """Positional time, open, high, low, close, volume after a header line; rows without a volume are dropped."""
    raw = spark.read.csv(path, header=True, enforceSchema=True, schema="time string, open double, high double, low double, close double, volume double")
    return with_index(raw.where("volume is not null").select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), iso_parts(F.col("time"))["time"].alias("time"), *PRICES, "volume"))


def read_strict_csv(spark: SparkSession, path: str, symbol: str, tf: int = 1) -> DataFrame:
    """Columns by lower-cased header name, validated; adds datetime, date, hour, minute and tz_offset."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*[c.strip().lower().lstrip("﻿") for c in raw.columns])
    missing = {"time", *PRICES, "volume"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    number = lambda c: F.trim(c).try_cast("double").alias(c)
    numbered = raw.withColumn("__at", F.monotonically_increasing_id())
    parts = iso_parts(F.trim("time"))
    bars = numbered.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), "__at", F.trim("time").alias("datetime"), *[v.alias(k) for k, v in parts.items()], *[number(c) for c in (*PRICES, "volume")])
    check(bars, order="__at")
    return with_index(bars.drop("__at"))


def problems(bars: DataFrame, order: str = "time") -> DataFrame:
    """problem and rows: every way in which bars break the rules, by one pass."""
    after = F.lag("time").over(Window.partitionBy("symbol", "tf").orderBy(order))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    all_finite = finite("open") & finite("high") & finite("low") & finite("close") & finite("volume")
    what = (
        F.when(F.col("time").isNull(), "timestamp")
        .when(F.col("__after") == F.col("time"), "duplicate time")
        .when(F.col("__after") > F.col("time"), "disorder")
        .when(~all_finite, "not finite")
        .when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "inconsistent prices")
        .when(F.col("volume") < 0, "negative volume")
    )
    return bars.withColumn("__after", after).select(what.alias("problem")).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


def check(bars: DataFrame, order: str = "time") -> DataFrame:
    """bars, or ValueError if a row breaks the rules or there is none."""
    found = problems(bars, order).collect()  # one row a kind of problem
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.rows} rows" for r in sorted(found)))
    if bars.isEmpty():
        raise ValueError("no rows")
    return bars


def candles_from_events(spark: SparkSession, sf_dir: str, tf: int = 60, symbol: str = "event_type", offset: float = 0.0) -> DataFrame:
    """Bars of the tick-like events table: one series for each event type, or a single one for symbol=None; `offset` is added to each value."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", *([symbol] if symbol else []))
    return with_index(candles(ticks.withColumn("symbol", F.col(symbol) if symbol else F.lit("ALL")), tf, price=F.col("value") + offset))


def candles(ticks: DataFrame, tf: int, price: Column | str = "value") -> DataFrame:
    """Bars of ticks (symbol, ts, event_id and a price); volume is the number of ticks."""
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    at = F.struct("ts", "event_id")
    px = F.col(price) if isinstance(price, str) else price
    priced = ticks.select("symbol", (F.floor(second / (tf * 60)) * (tf * 60)).alias("time"), px.alias("px"), at.alias("at"))
    return priced.groupBy("symbol", "time").agg(F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume")).select("symbol", F.lit(tf).alias("tf"), "time", *PRICES, "volume")


def upsert(rows: DataFrame) -> DataFrame:
    """Deltas (…, seq) of a bar merged in order: open of the first, extremes, close of the last, summed volume."""
    return with_index(
        rows.groupBy("symbol", "tf", "time").agg(F.min_by("open", "seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "seq").alias("close"), F.sum("volume").alias("volume"))
    )


def append(bars: DataFrame, more: DataFrame) -> DataFrame:
    """bars and more as one series, indexed again."""
    return with_index(bars.drop("i").unionByName(more.drop("i")))


def write_rows(df: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Parquet (or CSV with a header, nulls empty) of features, predictions or any other rows."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, nullValue="", **options) if kind == "csv" else writer.parquet(path, **options)


def write_features(df: DataFrame, path: str, metadata: Sequence[str], features: Sequence[str], targets: Sequence[str]) -> None:
    """CSV of exactly these columns in this order: numbers with ten significant digits, nulls empty, quotes doubled."""
    kinds = dict(df.dtypes)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    shown = lambda c: bare(F.format_string("%.10g", F.col(c).cast("double"))) if kinds[c] in ("double", "float") else F.col(c)
    columns = [F.when(F.col(c).isNotNull(), shown(c)).alias(c) for c in (*metadata, *features, *targets)]
    df.select(columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def predictions(rows: DataFrame, targets: Sequence[str], predicted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns, then actual_<t>, prediction_<t> and residual_<t> (actual less prediction) of each target."""
    of = lambda t, p: (F.col(t).alias(f"actual_{t}"), F.col(p).alias(f"prediction_{t}"), (F.col(t) - F.col(p)).alias(f"residual_{t}"))
    return rows.select(*keep, *[c for t, p in zip(targets, predicted, strict=True) for c in of(t, p)])


def read_features(spark: SparkSession, path: str, targets: dict[str, int]) -> DataFrame:
    """Feature rows in time order; rows whose label is incomplete or negative are left out; impossible labels raise."""
    rows = (spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)).dropna(subset=list(targets))
    rows = rows.where(" AND ".join(f"{t} >= 0" for t in targets))
    names = list(targets)
    wrong = " OR ".join([f"{t} > {most}" for t, most in targets.items()] + [f"{a} > {b}" for a, b in zip(names, names[1:], strict=False)])
    if not rows.where(wrong).isEmpty():
        raise ValueError("a label exceeds its window or a longer window's label")
    return rows


def report(path: str, values: dict, inputs: tuple[str, ...] = ()) -> None:
    """A JSON report with the SHA-256 of its local inputs."""
    digest = {}
    for p in inputs:
        with open(p, "rb") as f:
            digest[p] = hashlib.file_digest(f, "sha256").hexdigest()
    Path(path).write_text(json.dumps(values | {"inputs": digest}, indent=2, sort_keys=True) + "\n")
