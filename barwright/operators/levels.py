"""Price levels: previous day and week, zigzag and structure Fibonacci levels, inner zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY

FIBONACCI = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
MANUAL = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.414, 1.618)


def period_key(time: Column, period: str, offset: int = 0) -> Column:
    """The session day (D) or the day of its week's Monday (W), in days since 1970."""
    day = F.floor((time + offset) / 86400)
    return day if period == "D" else day - F.pmod(day + 3, F.lit(7))


def previous_high_low(bars: DataFrame, period: str, offset: int = 0) -> DataFrame:
    """For each period its predecessor's high and low (of periods that have bars), known from its first bar on."""
    at = bars.withColumn("period", period_key(F.col("time"), period, offset))
    groups = at.groupBy(*KEY, "period").agg(F.min("i").alias("available_i"), F.max("high").alias("h"), F.min("low").alias("l"), F.min_by("i", F.struct((-F.col("high")).alias("x"), F.col("i"))).alias("h_i"), F.min_by("i", F.struct("low", "i")).alias("l_i"))
    w = Window.partitionBy(*KEY).orderBy("period")
    before = {c: F.lag(c).over(w) for c in ("h", "l", "h_i", "l_i")}
    out = groups.select(*KEY, "period", "available_i", *[v.alias(k) for k, v in before.items()]).where("h is not null")
    each = F.explode(F.array(F.struct(F.lit(f"P{period}H").alias("type"), F.col("h").alias("price"), F.col("h_i").alias("anchor_i")), F.struct(F.lit(f"P{period}L").alias("type"), F.col("l").alias("price"), F.col("l_i").alias("anchor_i"))))
    return out.withColumn("x", each).select(*KEY, F.col("x.type").alias("type"), "period", F.col("x.price").alias("price"), F.col("x.anchor_i").alias("anchor_i"), "available_i")


def levels_at(levels: DataFrame, bars: DataFrame, kinds: tuple[str, ...] = ("PDH", "PDL", "PWH", "PWL")) -> DataFrame:
    """bars with each level type's price as known there: types are columns of one table, so one join serves all of them."""
    from .joins import as_of

    wide = levels.groupBy(*KEY, "available_i").agg(*[F.max(F.when(F.col("type") == k, F.col("price"))).alias(k.lower()) for k in kinds])
    w = Window.partitionBy(*KEY).orderBy("available_i").rowsBetween(Window.unboundedPreceding, 0)
    held = wide.select(*KEY, "available_i", *[F.last(k.lower(), ignorenulls=True).over(w).alias(f"{k.lower()}_price") for k in kinds])
    return as_of(bars, held, "i", "available_i", [f"{k.lower()}_price" for k in kinds])


def support_resistance(bars: DataFrame, hours: int = 4, offset: int = 0) -> DataFrame:
    """For each local 4-hour group (or any) the high and low of the group before it that has bars."""
    at = bars.withColumn("g", F.floor((F.col("time") + offset) / (hours * 3600)))
    groups = at.groupBy(*KEY, "g").agg(F.min("i").alias("available_i"), F.max("high").alias("h"), F.min("low").alias("l"))
    w = Window.partitionBy(*KEY).orderBy("g")
    return groups.select(*KEY, "g", "available_i", F.lag("h").over(w).alias("resistance"), F.lag("l").over(w).alias("support")).where("resistance is not null")


def zone_levels(zigzag: DataFrame, cursor: int, *, tick: float = 0.01, most: int = 5, with_618: bool = True, with_786: bool = True) -> DataFrame:
    """Extensions of the leg before last from the last pivot but one; levels go on up to the first beyond the last price.

    Optional levels (0.618, 0.786) are always kept. Rounds half away from zero.
    """
    optional = [r for r, on in ((0.618, with_618), (0.786, with_786)) if on]
    ratios = optional + [round(x + d, 3) for x in range(1, most + 1) for d in (0, 0.272, 0.414, 0.618)]
    known = zigzag.where((F.col("i") <= cursor) & (F.col("confirmed_i") <= cursor)).dropDuplicates(["symbol", "tf", "i", "price"])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("i"), F.desc("price")))
    last = known.withColumn("place", place).where("place <= 3").groupBy(*KEY)
    point = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    three = last.agg(point(1, "price").alias("current"), point(2, "price").alias("base"), point(3, "price").alias("anchor"), point(3, "i").alias("anchor_i")).where("anchor is not null and current <> base")
    at = three.select("*", F.posexplode(F.array(*[F.lit(float(r)) for r in ratios])).alias("index", "ratio"))
    up = F.col("current") > F.col("base")
    at = at.withColumn("price", F.col("base") + (F.col("anchor") - F.col("base")) * F.col("ratio"))
    beyond = F.when(up, F.col("price") > F.col("current")).otherwise(F.col("price") < F.col("current"))
    before = F.max(beyond.cast("int")).over(Window.partitionBy(*KEY).orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("__stop", F.coalesce(before, F.lit(0)))
    at = at.where((F.col("__stop") == 0) | (F.col("index") <= len(optional)))
    scaled = F.col("price") / tick
    rounded = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)) * tick
    return at.select(*KEY, "index", "ratio", "price", rounded.alias("rounded_price"), F.when(up, "bullish").otherwise("bearish").alias("direction"), "anchor_i")


def fibonacci(zigzag: DataFrame, close: DataFrame | None = None, ratios: tuple[float, ...] = FIBONACCI, near: float = 0.005) -> DataFrame:
    """Levels between the last high and the last low of a zigzag; near_price marks those within 0.5 % of the last close."""
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.struct("i", "price")), F.when(F.col("kind") == k, F.col("i")))
    two = zigzag.groupBy(*KEY).agg(last("high").alias("h"), last("low").alias("l")).where("h is not null and l is not null")
    at = two.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    rising = F.col("l.i") < F.col("h.i")
    size = F.col("h.price") - F.col("l.price")
    at = at.select(*KEY, "ratio", F.when(rising, F.col("h.price") - size * F.col("ratio")).otherwise(F.col("l.price") + size * F.col("ratio")).alias("price"))
    if close is None:
        return at
    end = close.groupBy(*KEY).agg(F.max_by("close", "i").alias("__close"))
    return at.join(end, KEY).withColumn("near_price", F.abs(F.col("price") - F.col("__close")) <= F.col("__close") * near).drop("__close")


def structure_fibonacci(events: DataFrame, bars: DataFrame, ratios: tuple[float, ...] = FIBONACCI) -> DataFrame:
    """Levels over the bars from pivot to break of the latest event (an external one if there is any)."""
    best = events.groupBy(*KEY).agg(F.max_by(F.struct("pivot_i", "i", "direction"), F.struct((F.col("scope") == "external").alias("x"), F.col("i"))).alias("e"))
    at = bars.join(best, KEY).where((F.col("i") >= F.col("e.pivot_i")) & (F.col("i") <= F.col("e.i")))
    two = at.groupBy(*KEY, "e").agg(F.max("high").alias("h"), F.min("low").alias("l")).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return two.select(*KEY, F.col("e.direction").alias("direction"), "ratio", F.when(F.col("e.direction") == "bull", F.col("h") - (F.col("h") - F.col("l")) * F.col("ratio")).otherwise(F.col("l") + (F.col("h") - F.col("l")) * F.col("ratio")).alias("price"))


def manual_fibonacci(spans: DataFrame) -> DataFrame:
    """Ten levels from price `from_price` to `to_price` of each span, extensions included."""
    return spans.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in MANUAL]))).withColumn("price", F.col("to_price") - (F.col("to_price") - F.col("from_price")) * F.col("ratio"))
