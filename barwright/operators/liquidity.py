"""Liquidity levels at swing highs and lows: equal levels, sweeps and how they end."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, along, rows_between
from .joins import first_beyond, nearest_open
from .pivots import pivots, scoped

LEVEL_SCHEMA = "i int, price double, type string, side string, confirmed_i int, scope string, scope_confirmed_i int, swept_i int, resolved_i int, classification string, bars_out int"
#: Bars after a sweep within which a level resolves.
LOOK = 30


def base_levels(bars: DataFrame, k: int = 3, external_k: int = 9) -> DataFrame:
    """A level for each pivot: BSL/sh at highs, SSL/sl at lows."""
    found = scoped(pivots(bars, k), pivots(bars, external_k))
    high = F.col("kind") == "high"
    return found.withColumn("type", F.when(high, "BSL").otherwise("SSL")).withColumn("side", F.when(high, "sh").otherwise("sl"))


def levels(bars: DataFrame, k: int = 3, external_k: int = 9, n_accept: int = 3) -> DataFrame:
    """base_levels as resolved() tells how they end."""
    return resolved(bars, base_levels(bars, k, external_k), n_accept)


def resolved(bars: DataFrame, base: DataFrame, n_accept: int = 3) -> DataFrame:
    """base levels with the bar that swept each, the bar that resolved it and as what.

    A level is swept by the first later bar beyond its price. It resolves at the
    first close back inside (SWEEP at once or after more than three bars, else
    GRAB, BIG_GRAB if external) or at the last of n_accept closes outside (RUN),
    whichever comes first; the closes looked at are those of n_accept bars.
    """
    rows = base.select(*KEY, "i", "price", "type", "side", "confirmed_i", "scope", "scope_confirmed_i").withColumn("__side", F.when(F.col("side") == "sh", 1).otherwise(-1))
    swept = first_beyond(rows, bars, after="confirmed_i", price="price", way="__side", to="swept_i")
    looked = min(n_accept, LOOK + 1)
    closes = bars.select(*KEY, F.col("i").alias("swept_i"), F.collect_list("close").over(rows_between(0, looked - 1)).alias("__c"), F.lead("i", LOOK).over(along()).alias("__far"), F.max("i").over(Window.partitionBy(*KEY)).alias("__end"))
    at = swept.join(closes, [*KEY, "swept_i"], "left")
    inside = F.array_position(F.transform("__c", lambda c: ~(c * F.col("__side") > F.col("price") * F.col("__side"))), F.lit(True)) - 1
    at = at.withColumn("__in", inside)
    back = F.col("__in") >= 0
    run = (F.col("__in") < 0) & (F.size("__c") >= n_accept)
    name = F.when((F.col("__in") == 0) | (F.col("__in") > 3), "SWEEP").when(F.col("scope") == "external", "BIG_GRAB").otherwise("GRAB")
    out = at.withColumn("resolved_i", F.when(back, F.col("swept_i") + F.col("__in")).when(run, F.col("swept_i") + n_accept - 1).cast("int"))
    out = out.withColumn("classification", F.when(back, name).when(run, "RUN"))
    out = out.withColumn("bars_out", F.when(back, F.col("__in")).when(~run, F.coalesce("__far", "__end") - F.col("swept_i")).cast("int"))
    return out.select(*KEY, *[x.split()[0] for x in LEVEL_SCHEMA.split(", ")])


def equal_levels(base: DataFrame, bars: DataFrame, *, tolerance: float = 0.05, reach: int = 100) -> DataFrame:
    """Pairs of levels of a side at almost one price: the later one (i) with the nearest earlier one (eq_pair).

    bars need column atr_late; the earlier level must not have been passed by
    more than the tolerance between its confirmation and the later level. Each
    level meets those of its own and the bucket before, `reach` bars wide.
    """
    atr = bars.select(*KEY, "i", F.when(F.col("atr_late") > 0, F.col("atr_late")).alias("a"))
    at = base.select(*KEY, "side", "i", "price", "confirmed_i").join(atr, [*KEY, "i"])
    at = at.withColumn("b", F.floor(F.col("i") / reach))
    prior = at.select(*KEY, "side", F.col("i").alias("p_i"), F.col("price").alias("p_price"), F.col("confirmed_i").alias("p_confirmed"), F.col("a").alias("p_a"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    two = at.join(prior, [*KEY, "side", "b"]).where((F.col("p_i") < F.col("i")) & (F.col("i") - F.col("p_i") <= reach))
    mean = F.coalesce((F.col("p_a") + F.col("a")) / 2, F.col("p_a"), F.col("a"))
    two = two.withColumn("mean", mean).withColumn("tolerance", F.col("mean") * tolerance).withColumn("difference", F.abs(F.col("p_price") - F.col("price")))
    two = two.where((F.col("tolerance") > 0) & (F.col("difference") <= F.col("tolerance")))
    # highest high and lowest low between, from bars of the at most two buckets that the gap spans
    gap = bars.select(*KEY, F.col("i").alias("j"), "high", "low", F.floor(F.col("i") / reach).alias("jb"))
    spans = two.select(*KEY, "side", "i", "p_i", "p_price", "p_confirmed", "tolerance", F.explode(F.array_distinct(F.array(F.floor(F.col("p_i") / reach), F.floor(F.col("i") / reach)))).alias("jb"))
    passed = F.when(F.col("side") == "sh", F.col("high") > F.col("p_price") + F.col("tolerance")).otherwise(F.col("low") < F.col("p_price") - F.col("tolerance"))
    consumed = spans.join(gap, [*KEY, "jb"]).where((F.col("j") > F.col("p_confirmed")) & (F.col("j") < F.col("i")) & passed).select(*KEY, "side", "i", "p_i").distinct()
    free = two.join(consumed, [*KEY, "side", "i", "p_i"], "left_anti")
    nearest = free.groupBy(*KEY, "side", "i").agg(F.max_by(F.struct("p_i", "p_price", "p_confirmed", "price", "confirmed_i", "mean", "tolerance", "difference"), "p_i").alias("x"))
    return nearest.select(*KEY, "side", "i", F.col("x.p_i").alias("eq_pair"), ((F.col("x.p_price") + F.col("x.price")) / 2).alias("eq_price"), F.greatest("x.p_confirmed", "x.confirmed_i").alias("eq_confirmed_i"), F.col("x.tolerance").alias("eq_tolerance"), (F.col("x.difference") / F.col("x.mean")).alias("eq_deviation_atr"))


def with_equals(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Levels with is_eqh, is_eql, eq_pair, eq_price and the earliest eq_confirmed_i of any pair they are in."""
    own = pairs.select(*KEY, "side", "i", "eq_pair", "eq_price", F.col("eq_confirmed_i").alias("__own"))
    as_prior = pairs.groupBy(*KEY, "side", F.col("eq_pair").alias("i")).agg(F.min("eq_confirmed_i").alias("__prior"), F.sort_array(F.collect_list(F.col("i"))).alias("eq_followers"))
    out = found.join(own, [*KEY, "side", "i"], "left").join(as_prior, [*KEY, "side", "i"], "left")
    paired = F.col("__own").isNotNull() | F.col("__prior").isNotNull()
    out = out.withColumn("is_eqh", paired & (F.col("side") == "sh")).withColumn("is_eql", paired & (F.col("side") == "sl"))
    return out.withColumn("eq_confirmed_i", F.least("__own", "__prior")).drop("__own", "__prior")


def with_volume_score(found: DataFrame, bars: DataFrame, index: DataFrame) -> DataFrame:
    """volume_score: the multi-timeframe volume of the bar that swept the level (else its pivot), or that bar's own."""
    at = found.withColumn("__ref", F.coalesce("swept_i", "i"))
    ref = bars.select(*KEY, F.col("i").alias("__ref"), "time", "volume")
    out = at.join(ref, [*KEY, "__ref"]).join(index, ["symbol", "time"], "left")
    multi = F.col("v1m") + F.col("v5m") + F.col("v15m")
    return out.withColumn("volume_source", F.when(multi.isNull(), "native_fallback").otherwise("multi_timeframe_index")).withColumn("volume_score", F.coalesce(multi, F.col("volume"))).drop("__ref", "time", "volume", "v1m", "v5m", "v15m")


def weighted(found: DataFrame, percentile: float = 0.7) -> DataFrame:
    """Levels whose score reaches the nearest-rank percentile of positive scores (of the whole sample: it looks ahead).

    The rank is counted in decimals: as a double, 45 * 0.7 + 0.5 is less than 32.
    """
    scores = found.where("volume_score > 0").groupBy(*KEY).agg(F.sort_array(F.collect_list("volume_score")).alias("s"))
    rank = F.floor((F.size("s") - 1) * F.lit(Decimal(str(percentile))) + F.lit(Decimal("0.5"))).cast("int")
    least = scores.select(*KEY, F.get("s", rank).alias("least"))
    return found.join(least, KEY).where("volume_score >= least").drop("least")


def as_of(found: DataFrame, cursor: int) -> DataFrame:
    """Levels known at the cursor, what happened later taken back."""
    known = found.where(F.col("confirmed_i") <= cursor)
    later = F.coalesce(F.col("resolved_i") > cursor, F.lit(False))
    known = known.withColumn("classification", F.when(~later, F.col("classification"))).withColumn("resolved_i", F.when(~later, F.col("resolved_i")))
    known = known.withColumn("swept_i", F.when(F.col("swept_i") <= cursor, F.col("swept_i")))
    outside = F.col("scope_confirmed_i") > cursor
    return known.withColumn("scope", F.when(outside, "internal").otherwise(F.col("scope"))).withColumn("scope_confirmed_i", F.when(outside, F.col("confirmed_i")).otherwise(F.col("scope_confirmed_i")))


def nearest(bars: DataFrame, found: DataFrame, *, near_internal: float = 0.5, near_external: float = 0.75) -> DataFrame:
    """For each bar the nearest open level of either scope within a multiple of atr (first in order on ties).

    A level is internal until its external scope is confirmed. Open levels are
    swept in the order of their prices, so a bar looks at its two neighbours,
    however many levels are open and however far a single bar's atr reaches.
    """
    known = bars.select(*KEY, "i", "close", "atr").where("atr > 0")
    outer = F.col("scope") == "external"
    place = -(F.col("i") * 2 + F.when(F.col("side") == "sh", 0).otherwise(1)).cast("double")
    turn = F.greatest("confirmed_i", "scope_confirmed_i")
    end = F.col("resolved_i") - 1
    base = found.select(*KEY, "scope", F.col("price").alias("value"), place.alias("tie"), F.lit(0.0).alias("width"), "confirmed_i", turn.alias("turn"), end.alias("end"))
    each = F.array_compact(F.array(F.struct(F.lit("internal").alias("kind"), F.col("confirmed_i").alias("first"), F.when(outer, F.least("end", F.col("turn") - 1)).otherwise(F.col("end")).alias("last")), F.when(outer, F.struct(F.lit("external").alias("kind"), F.col("turn").alias("first"), F.col("end").alias("last")))))
    near = nearest_open(known, base.withColumn("x", F.explode(each)).select(*KEY, "x.kind", "value", "tie", "width", "x.first", "x.last"), point="i", at="i", ref="close")
    reach = F.col("atr") * F.when(F.col("kind") == "external", near_external).otherwise(near_internal)
    near = near.join(known, [*KEY, "i"]).where(F.abs(F.col("close") - F.col("value")) <= reach)
    level = F.struct(F.floor(-F.col("tie") / 2).cast("int").alias("i"), F.when(F.pmod(-F.col("tie"), F.lit(2)) == 0, "BSL").otherwise("SSL").alias("type"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, level))
    out = near.groupBy(*KEY, "i").agg(pick("internal").alias("n"), pick("external").alias("e"))
    return out.select(*KEY, "i", F.col("n.i").alias("internal_i"), F.col("n.type").alias("internal_type"), F.col("e.i").alias("external_i"), F.col("e.type").alias("external_type"))


def running_top(found: DataFrame, n: int) -> DataFrame:
    """The n newest levels of a series, newest first."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confirmed_i"), F.desc("i"), "side"))
    return found.withColumn("place", place).where(F.col("place") <= n)


def lookback_max(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("highest", F.max("high").over(rows_between(-(n - 1), 0))).withColumn("lowest", F.min("low").over(rows_between(-(n - 1), 0)))
