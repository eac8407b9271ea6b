"""Volume profiles and anchored VWAP."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, along

#: Volumes at nine places whose sums are the same in any order.
EXACT = "decimal(30,9)"


def session_segments(bars: DataFrame, open_seconds: int = 0) -> DataFrame:
    """bars with segment: the first bar of their session (days that start open_seconds after midnight UTC)."""
    day = ((F.col("time") - open_seconds) / 86400).cast("long")  # truncates, as sessions do
    at = bars.withColumn("__day", day)
    return at.withColumn("segment", F.min("i").over(Window.partitionBy(*KEY, "__day"))).drop("__day")


def event_segments(bars: DataFrame, events: DataFrame) -> DataFrame:
    """bars with segment: from one external break to the next; series without any get none."""
    starts = events.where("scope = 'external'").select(*KEY, "i").distinct()
    starts = starts.unionByName(starts.select(*KEY, F.lit(0).alias("i"))).distinct().withColumn("__start", F.col("i"))
    at = bars.join(starts, [*KEY, "i"], "left").join(starts.select(*KEY).distinct(), KEY, "left_semi")
    return at.withColumn("segment", F.last("__start", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def contingency_segment(bars: DataFrame, size: int = 500) -> DataFrame:
    """The last `size` bars of each series as one segment."""
    last = F.max("i").over(Window.partitionBy(*KEY))
    at = bars.withColumn("segment", F.greatest(last - max(2, size) + 1, F.lit(0)))
    return at.where(F.col("i") >= F.col("segment"))


def bins(segmented: DataFrame, n: int = 24) -> DataFrame:
    """Volume by price bin of each segment: a bar's volume is spread over the bins it overlaps; up and down apart."""
    key = [*KEY, "segment"]
    edge = segmented.groupBy(*key).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("i").alias("segment_end"))
    flat = F.col("hi") <= F.col("lo")
    pad = F.greatest(F.abs("lo") * 1e-9, F.lit(1e-9))
    edge = edge.withColumn("flat_price", F.when(flat, F.col("lo")))
    edge = edge.withColumns({"lo": F.when(flat, F.col("lo") - pad / 2).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + pad / 2).otherwise(F.col("hi"))}).withColumn("step", (F.col("hi") - F.col("lo")) / n)
    at = segmented.where("volume > 0").join(edge, key)
    place = lambda c: F.least(F.greatest(((F.col(c) - F.col("lo")) / F.col("step")).cast("int"), F.lit(0)), F.lit(n - 1))
    at = at.withColumn("bin", F.explode(F.sequence(place("low"), F.when(F.col("high") > F.col("low"), place("high")).otherwise(place("low")))))
    left, right = F.col("lo") + F.col("bin") * F.col("step"), F.col("lo") + (F.col("bin") + 1) * F.col("step")
    overlap = F.greatest(F.least(right, F.col("high")) - F.greatest(left, F.col("low")), F.lit(0.0))
    part = F.when(F.col("high") > F.col("low"), F.col("volume") * F.try_divide(overlap, F.col("high") - F.col("low"))).otherwise(F.col("volume"))
    up = F.col("close") >= F.col("open")
    sums = at.withColumn("part", part).groupBy(*key, "bin").agg(F.sum("part").alias("volume"), F.sum(F.when(up, F.col("part")).otherwise(0.0)).alias("up_volume"), F.sum(F.when(~up, F.col("part")).otherwise(0.0)).alias("down_volume"))
    traded = segmented.where("volume > 0").groupBy(*key).agg(F.sum("volume").alias("total"))
    grid = edge.join(traded, key).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = grid.join(sums, [*key, "bin"], "left").na.fill(0.0, ["volume", "up_volume", "down_volume"])
    return out.select(*key, "segment_end", "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("price_low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("price_high"), F.coalesce("flat_price", F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("price"), "volume", "up_volume", "down_volume", "total")


def whole(price: Column) -> Column:
    """A price (up to 9e9) in billionths, so that edges, overlaps and ties are exact."""
    return F.floor(price * 1e9 + 0.5)


def bin_at(price: Column, lo: Column, hi: Column, n: int) -> Column:
    """The bin of a whole() price, one of n from lo to hi; the last has its upper edge, too."""
    at, span = (price - lo) * n, F.greatest(hi - lo, F.lit(1))
    return F.when(hi > lo, F.least(((at - at % span) / span).cast("int"), F.lit(n - 1))).otherwise(n // 2)


def part(volume: Column, low: Column, high: Column, lo: Column, hi: Column, number: Column, n: int) -> Column:
    """What bin `number` of n gets of a bar's volume, of whole() prices and at nine places: bins covered in full get exactly the same."""
    left, span = number * (hi - lo), hi - lo
    overlap = F.least(left + span, (high - lo) * n) - F.greatest(left, (low - lo) * n)
    counted = F.when(high > low, volume * overlap / ((high - low) * n)).otherwise(volume) * 1e9 + 0.5
    return ((counted - counted % 1) / 1e9).cast(EXACT)


def value_area(binned: DataFrame, share: float = 0.7) -> DataFrame:
    """Point of control (first fullest bin) and the area around it that holds `share` of the volume.

    The area grows to the fuller neighbour (up on ties), a recurrence over the
    at most n bins of a segment: an array fold, no Python. Volumes compare at
    nine places, as their sums may be made in any order; volumes that are
    EXACT compare as they are, and a column slack (EXACT) is what the area may
    lack, as parts were rounded.
    """
    binned = binned.withColumn("volume", F.col("volume").cast(EXACT))
    slack = ["slack"] if "slack" in binned.columns else []
    enough = F.col("total").cast(EXACT) * F.lit(Decimal(str(share))) - (F.col("slack") if slack else F.lit(0))
    row = F.struct("bin", "volume", "price", "price_low", "price_high")
    out = binned.groupBy(*KEY, "segment", "segment_end", "total", *slack).agg(F.sort_array(F.collect_list(row)).alias("b"), F.min_by("bin", F.struct((-F.col("volume")).alias("v"), F.col("bin"))).alias("poc_bin"))
    vol = lambda k: F.coalesce(F.get(F.col("b"), k)["volume"], F.lit(-1).cast(EXACT))
    zero = F.struct(F.col("poc_bin").alias("lo"), F.col("poc_bin").alias("hi"), vol(F.col("poc_bin")).alias("v"))

    def grow(a: Column, _: Column) -> Column:
        above, below = vol(a["hi"] + 1), vol(a["lo"] - 1)
        up = F.struct(a["lo"].alias("lo"), (a["hi"] + 1).alias("hi"), (a["v"] + above).cast(EXACT).alias("v"))
        down = F.struct((a["lo"] - 1).alias("lo"), a["hi"].alias("hi"), (a["v"] + below).cast(EXACT).alias("v"))
        done = (a["v"] >= enough) | ((above < 0) & (below < 0))
        return F.when(done, a).when(above >= below, up).otherwise(down)

    out = out.withColumn("area", F.aggregate("b", zero, grow))
    at = lambda k, c: F.get(F.col("b"), k)[c]
    return out.select(*KEY, "segment", "segment_end", "total", at(F.col("poc_bin"), "price").alias("poc"), at(F.col("area.hi"), "price_high").alias("vah"), at(F.col("area.lo"), "price_low").alias("val"), vol(F.col("poc_bin")).cast("double").alias("max_volume"))


def poc_index(areas: DataFrame, segmented: DataFrame) -> DataFrame:
    """The first bar of each segment whose typical price is nearest to the point of control."""
    at = segmented.join(areas.select(*KEY, "segment", "poc"), [*KEY, "segment"])
    far = F.abs((F.col("high") + F.col("low") + F.col("close")) / 3.0 - F.col("poc"))
    first = at.groupBy(*KEY, "segment").agg(F.min_by("i", F.struct(far.alias("d"), F.col("i"))).alias("poc_i"))
    return areas.join(first, [*KEY, "segment"])


def vwap(segmented: DataFrame) -> DataFrame:
    """Running VWAP and volume-weighted deviation of the typical price from each segment's first bar; bars without volume have none.

    Sums are of differences to the segment's first price, so they don't cancel.
    """
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    w = Window.partitionBy(*KEY, "segment").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("volume") > 0
    at = segmented.withColumn("__tp", tp).withColumn("__ref", F.first("__tp").over(w))
    d = F.col("__tp") - F.col("__ref")
    at = at.withColumns({"__v": F.sum(F.when(ok, F.col("volume"))).over(w), "__d": F.sum(F.when(ok, F.col("volume") * d)).over(w), "__q": F.sum(F.when(ok, F.col("volume") * d * d)).over(w)})
    mean = F.col("__d") / F.col("__v")
    spread = F.greatest(F.col("__q") / F.col("__v") - mean * mean, F.lit(0.0))
    at = at.withColumn("vwap", F.when(ok, F.col("__ref") + mean)).withColumn("sigma", F.when(ok, F.sqrt(spread)))
    return at.drop("__tp", "__ref", "__v", "__d", "__q")


def bands(lines: DataFrame, times: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    return lines.withColumns({f"{side}_{k + 1}": F.col("vwap") + sign * t * F.col("sigma") for k, t in enumerate(times) for side, sign in (("upper", 1), ("lower", -1))})


def anchors(bars: DataFrame, *, session_seconds: int = 0, open_seconds: int = 34200, offset: int = 0, complete: bool = False) -> DataFrame:
    """session_start and market_open anchors: the first bar of a session; the first at or after the local open, else,
    for days that are over (or with complete), the day's first bar (metadata says which)."""
    local = F.col("time") + offset
    at = bars.withColumn("__s", ((local - session_seconds) / 86400).cast("long")).withColumn("__day", (local / 86400).cast("long")).withColumn("__sec", local - F.col("__day") * 86400)
    starts = at.groupBy(*KEY, "__s").agg(F.min("i").alias("i")).select(*KEY, "i", F.lit("session_start").alias("source"), F.lit(None).cast("string").alias("metadata"))
    days = at.groupBy(*KEY, "__day").agg(F.min("i").alias("first"), F.min(F.when(F.col("__sec") >= open_seconds, F.col("i"))).alias("open"))
    last = days.withColumn("__last", F.max("__day").over(Window.partitionBy(*KEY)))
    opens = last.where(F.col("open").isNotNull() | (F.col("__day") < F.col("__last")) | F.lit(complete))
    opens = opens.select(*KEY, F.coalesce("open", "first").alias("i"), F.lit("market_open").alias("source"), F.when(F.col("open").isNull(), "first_available_session_candle").otherwise("official_open_time").alias("metadata"))
    return starts.unionByName(opens)


def event_anchors(events: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Anchors at breaks (bos, choch) and at points of control (poc_index())."""
    out = events.select(*KEY, "i", F.lower("type").alias("source"), F.lit(None).cast("string").alias("metadata"))
    if areas is not None:
        out = out.unionByName(areas.select(*KEY, F.col("poc_i").alias("i"), F.lit("poc").alias("source"), F.lit(None).cast("string").alias("metadata")))
    return out


def merged(found: DataFrame, bars: DataFrame) -> DataFrame:
    """One line for each anchor bar with its sources; a line ends where the next begins."""
    lines = found.groupBy(*KEY, "i").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.max(F.when(F.col("source") == "market_open", F.col("metadata"))).alias("metadata"))
    end = bars.groupBy(*KEY).agg(F.max("i").alias("__end"))
    return lines.join(end, KEY).withColumn("end_i", F.coalesce(F.lead("i").over(along()) - 1, F.col("__end"))).drop("__end")


def lines(bars: DataFrame, merged_anchors: DataFrame) -> DataFrame:
    """VWAP lines from each anchor to the next: every bar belongs to the last anchor at or before it."""
    at = bars.join(merged_anchors.select(*KEY, "i", F.col("i").alias("__a")), [*KEY, "i"], "left")
    at = at.withColumn("segment", F.last("__a", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))).drop("__a")
    return vwap(at.where("segment is not null"))


def missed_anchor(missed: DataFrame, cursor: int) -> DataFrame:
    """The missed pivot known last at the cursor: an anchor of its own."""
    known = missed.where((F.col("source") == "missed") & (F.col("confirmed_i") <= cursor) & (F.col("i") <= cursor))
    best = known.groupBy(*KEY).agg(F.max_by(F.struct("i", "kind", "price", "confirmed_i"), F.struct("confirmed_i", "i", "kind")).alias("b"))
    return best.select(*KEY, "b.*")


def range_vwap(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """VWAP and volume-weighted deviation over any (first, last) from running sums: two lookups a span instead of a scan.

    Sums are of differences to the series' first price, so that squares don't cancel.
    """
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    w = along().rowsBetween(Window.unboundedPreceding, 0)
    at = bars.withColumn("__ref", F.first(tp).over(w))
    d = tp - F.col("__ref")
    sums = at.select(*KEY, "i", "__ref", F.sum("volume").over(w).alias("v"), F.sum(F.col("volume") * d).over(w).alias("p"), F.sum(F.col("volume") * d * d).over(w).alias("q"))
    hi = sums.select(*KEY, "__ref", F.col("i").alias("last"), *[F.col(c).alias(f"__{c}1") for c in "vpq"])
    lo = sums.select(*KEY, (F.col("i") + 1).alias("first"), *[F.col(c).alias(f"__{c}0") for c in "vpq"])
    zero = [f"__{c}0" for c in "vpq"]
    out = spans.join(hi, [*KEY, "last"]).join(lo, [*KEY, "first"], "left").na.fill(0.0, zero)
    part = lambda c: F.col(f"__{c}1") - F.col(f"__{c}0")
    mean = F.try_divide(part("p"), part("v"))
    spread = F.greatest(F.try_divide(part("q"), part("v")) - mean * mean, F.lit(0.0))
    return out.withColumn("vwap", F.col("__ref") + mean).withColumn("sigma", F.when(mean.isNotNull(), F.sqrt(spread))).drop("__ref", *zero, "__v1", "__p1", "__q1")


def range_profile(bars: DataFrame, spans: DataFrame, n: int = 50, share: float = 0.7) -> DataFrame:
    """poc, vah, val of the bars of any spans (first, last), which may overlap; a flat span has its one price for all three, one without volume none."""
    from .joins import within

    at = within(bars.select(*KEY, "i", "open", "high", "low", "close", "volume"), spans.select(*KEY, "first", "last"), "i", "first", "last").withColumn("segment", F.struct("first", "last")).drop("first", "last")
    edge = at.groupBy(*KEY, "segment").agg(F.min("low").alias("__lo"), F.max("high").alias("__hi"))
    areas = value_area(bins(at, n), share).join(edge, [*KEY, "segment"])
    flat = F.col("__hi") <= F.col("__lo")
    return areas.select(*KEY, F.col("segment.first").alias("first"), F.col("segment.last").alias("last"), "total", "poc", *[F.when(flat, F.col("__lo")).otherwise(F.col(c)).alias(c) for c in ("vah", "val")])
