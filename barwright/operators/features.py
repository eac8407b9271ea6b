"""Point-in-time event features, forward labels, and preparation for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY

HORIZONS = (3, 5, 10, 15)
PIP = 0.25


def labels(events: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """events with Y_<n>m, the later events with time in (t, t + n minutes], and complete (bars reach the last horizon)."""
    out = events
    for n in horizons:
        w = Window.partitionBy(*KEY).orderBy("event_time").rangeBetween(1, n * 60)
        out = out.withColumn(f"Y_{n}m", F.count(F.lit(1)).over(w))
    end = bars.groupBy(*KEY).agg(F.max("time").alias("__end"))
    return out.join(end, KEY).withColumn("complete", F.col("__end") >= F.col("event_time") + max(horizons) * 60).drop("__end")


def last_closed(points: DataFrame, bars: DataFrame, tf: int, at: str = "event_time") -> DataFrame:
    """points with the last bar of tf minutes (closed_i, closed_time) that has ended at their time."""
    from .joins import as_of

    ended = bars.select("symbol", F.col("i").alias("closed_i"), F.col("time").alias("closed_time"), (F.col("time") + tf * 60).alias("__ended"))
    each = points.select("symbol", "tf").distinct()
    return as_of(points, each.join(ended, "symbol"), at, "__ended", ["closed_i", "closed_time"])


def reference_price(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events with the mean of high, low and close of the ghost bar."""
    price = bars.select(*KEY, F.col("i").alias("ghost_i"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("ref"))
    return events.join(price, [*KEY, "ghost_i"])


def active(points: DataFrame, zones: DataFrame, at: str, lookback: int | None = None) -> DataFrame:
    """Pairs of points and zones (confirmed_i, end_i) that are known and open there, of any age.

    With lookback at most that many bars old, as structure breaks and resolved
    levels are taken; blocks, gaps and levels are not.
    """
    from .joins import within

    to = F.col("end_i") - 1
    spans = zones.withColumn("__to", to if lookback is None else F.least(to, F.col("confirmed_i") + lookback))
    return within(points, spans, at, "confirmed_i", "__to").drop("__to")


def nearest_zone(pairs: DataFrame, point: Sequence[str], ref: str = "ref") -> DataFrame:
    """For each point the zone whose middle is nearest (the later confirmed on ties) and its signed distance in pips."""
    mid = (F.col("top") + F.col("bottom")) / 2
    best = F.min_by(mid, F.struct(F.abs(mid - F.col(ref)).alias("d"), (-F.col("confirmed_i")).alias("c")))
    return pairs.groupBy(*point, ref).agg(best.alias("__mid")).withColumn("pips", signed_pips(F.col("__mid"), F.col(ref))).drop("__mid")


def nearest_price(pairs: DataFrame, point: Sequence[str], price: str = "price", ref: str = "ref") -> DataFrame:
    """For each point the nearest price (the higher on ties) and its signed distance in pips."""
    best = F.min_by(price, F.struct(F.abs(F.col(price) - F.col(ref)).alias("d"), (-F.col(price)).alias("p")))
    return pairs.groupBy(*point, ref).agg(best.alias("nearest")).withColumn("pips", signed_pips(F.col("nearest"), F.col(ref)))


def signed_pips(level: Column, ref: Column) -> Column:
    return (level - ref) / PIP


def alternating(pivots: DataFrame, cursor: int) -> DataFrame:
    """The last pivot known at the cursor and the last of the other kind."""
    known = pivots.where(F.col("confirmed_i") <= cursor)
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.struct("i", "price", "kind")), F.when(F.col("kind") == k, F.struct("confirmed_i", "i")))
    two = known.groupBy(*KEY).agg(last("high").alias("h"), last("low").alias("l"))
    first = F.coalesce(F.col("h.i") >= F.col("l.i"), F.col("h").isNotNull())
    return two.select(*KEY, F.when(first, F.col("h")).otherwise(F.col("l")).alias("latest"), F.when(first, F.col("l")).otherwise(F.col("h")).alias("opposite"))


def snapshot(events: DataFrame, bars: DataFrame, levels: DataFrame, gaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each event, signed pips from its reference price to the nearest open level of each side, gap and block of each direction.

    A point sees what was confirmed by the last bar closed before its event.
    """
    points = reference_price(events, bars).withColumn("cursor", F.col("event_i") - 1).where("cursor >= 0")
    id_ = [*KEY, "event_i"]
    points = points.select(*id_, "event_time", "cursor", "ref")
    spans = levels.select(*KEY, F.concat(F.lit("level_"), "side").alias("what"), F.col("price").alias("top"), F.col("price").alias("bottom"), "confirmed_i", F.col("resolved_i").alias("end_i"))
    for name, zones in (("gap", gaps), ("block", blocks)):
        spans = spans.unionByName(zones.select(*KEY, F.concat(F.lit(f"{name}_"), "direction").alias("what"), "top", "bottom", "confirmed_i", "end_i"))
    mid = (F.col("top") + F.col("bottom")) / 2
    is_level = F.col("what").startswith("level_")
    nearer = F.struct(F.abs(mid - F.col("ref")).alias("d"), F.when(is_level, -mid).otherwise(-F.col("confirmed_i")).alias("tie"))
    names = ("level_sh", "level_sl", "gap_bull", "gap_bear", "block_bull", "block_bear")
    best = [F.min_by(F.when(F.col("what") == n, mid), F.when(F.col("what") == n, nearer)).alias(n) for n in names]
    found = active(points, spans, "cursor").groupBy(*id_).agg(*best)
    out = points.join(found, id_, "left")
    return out.select(*points.columns, *[signed_pips(F.col(n), F.col("ref")).alias(f"{n}_pips") for n in names])


def fit_scaler(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """One row: median, mean and deviation (population; 1 if none) of each column after medians fill its gaps."""
    medians = rows.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_median") for c in numeric])
    filled = rows.join(F.broadcast(medians))
    value = lambda c: F.coalesce(c, f"{c}_median")
    stats = filled.agg(*[x for c in numeric for x in (F.avg(value(c)).alias(f"{c}_mean"), F.stddev_pop(value(c)).alias(f"{c}_sd"))])
    sd = {f"{c}_sd": F.when(F.col(f"{c}_sd") <= 1e-12, 1.0).otherwise(F.col(f"{c}_sd")) for c in numeric}
    return medians.join(stats).withColumns(sd)


def scale(rows: DataFrame, scaler: DataFrame, numeric: Sequence[str], levels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """rows with <c>_z for numbers (gaps filled by the median) and a 0/1 column for each level; unknown levels are all 0."""
    at = rows.join(F.broadcast(scaler))
    z = {f"{c}_z": (F.coalesce(c, f"{c}_median") - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in numeric}
    one_hot = {f"{c}={v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in (levels or {}).items() for v in vs}
    return at.withColumns(z | one_hot).drop(*scaler.columns)


def sequences(rows: DataFrame, columns: Sequence[str], order: str = "event_time", length: int = 16) -> DataFrame:
    """For each row with length-1 before it, the array of their feature vectors, oldest first."""
    w = Window.partitionBy(*KEY).orderBy(order).rowsBetween(-(length - 1), 0)
    at = rows.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    return at.where(F.size("sequence") == length)


def temporal_split(rows: DataFrame, order: str = "event_time", share: float = 0.8, purge_seconds: int = 900) -> DataFrame:
    """rows with part: train (the first share, ending purge_seconds before the rest), purged or validation."""
    w = Window.partitionBy(*KEY)
    place = F.row_number().over(w.orderBy(order))
    at = rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__p", place)
    at = at.withColumn("__cut", F.floor(F.col("__n") * share))
    start = F.min(F.when(F.col("__p") > F.col("__cut"), F.col(order))).over(w)
    at = at.withColumn("__start", start)
    part = F.when(F.col("__p") > F.col("__cut"), "validation").when(F.col(order) + purge_seconds > F.col("__start"), "purged").otherwise("train")
    return at.withColumn("part", part).drop("__n", "__p", "__cut", "__start")


def constrained(rows: DataFrame, predictions: Sequence[str], limits: Sequence[int] = HORIZONS) -> DataFrame:
    """Count predictions clipped to their limits and made non-decreasing over the horizons."""
    last, out = None, {}
    for c, top in zip(predictions, limits, strict=True):
        value = F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(top)))
        last = value if last is None else F.least(F.greatest(value, last), F.lit(float(top)))
        out[c] = last
    return rows.withColumns(out)


def metrics(rows: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, r2, exact and within_one (percent, predictions rounded half to even)."""
    e = F.col(predicted) - F.col(actual)
    near = F.abs(F.rint(predicted) - F.col(actual))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"), (F.var_pop(actual) * F.count(F.lit(1))).alias("__sst"), (100 * F.avg((near == 0).cast("double"))).alias("exact"), (100 * F.avg((near <= 1).cast("double"))).alias("within_one"))
    return out.withColumn("r2", F.when(F.col("__sst") > 0, 1 - F.col("__sse") / F.col("__sst"))).drop("__sse", "__sst")
