"""What a series shows at every one of its bars: profiles, anchored lines and structure as known there.

A cursor sees only bars up to itself and what they had confirmed. All cursors
of all series are answered at once, from running sums and counts, instead of
computing a prefix of the bars anew for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profile as A
from .core import KEY, along, rows_between
from .joins import as_of, within
from .pivots import pivots

UPTO = (Window.unboundedPreceding, 0)


def profiles_at(segmented: DataFrame, n: int = 24, share: float = 0.7) -> DataFrame:
    """poc, vah, val and total of each segment as a cursor at each of its bars sees it, and whether bars of it were yet to come (truncated).

    A segment that is over shows what its last bar saw. The bins' edges move
    only with a new high or low. Between two of those the histogram grows by
    each bar's own part, so it is made anew once for each move of the edges and
    summed on from there, not once for each cursor. Parts are counted exactly
    (profile.part()), so bins that are equally full tie however much volume
    there is, and the first of them is the point of control. An area that holds
    the share but for what rounding took, half a billionth a part, holds it.
    """
    key = [*KEY, "segment"]
    w = Window.partitionBy(*key).orderBy("i")
    upto = w.rowsBetween(*UPTO)
    at = segmented.withColumn("lo", F.min("low").over(upto)).withColumn("hi", F.max("high").over(upto)).withColumn("total", F.sum(F.when(F.col("volume") > 0, F.col("volume"))).over(upto))
    at = at.withColumn("slack", (F.count(F.when(F.col("volume") > 0, 1)).over(upto) * n * 5e-10).cast(A.EXACT))
    moved = F.coalesce((F.lag("lo").over(w) != F.col("lo")) | (F.lag("hi").over(w) != F.col("hi")), F.lit(True))
    at = at.withColumn("__moved", moved).withColumn("stretch", F.sum(F.col("__moved").cast("int")).over(upto))
    flat = F.col("hi") <= F.col("lo")
    pad = F.greatest(F.abs("lo") * 1e-9, F.lit(1e-9))
    low_edge, high_edge = F.when(flat, F.col("lo") - pad / 2).otherwise(F.col("lo")), F.when(flat, F.col("hi") + pad / 2).otherwise(F.col("hi"))
    edges = {"__lo": low_edge, "step": (high_edge - low_edge) / n}
    stretches = at.where("__moved").select(*key, "stretch", F.col("i").alias("begin"), *[A.whole(F.col(c)).alias(c) for c in ("lo", "hi")])
    own = at.where("volume > 0").select(*key, "i", *[A.whole(F.col(c)).alias(c) for c in ("low", "high")], "volume", F.col("stretch").alias("__own"))
    parts = own.join(stretches, key).where("__own <= stretch")
    lo, hi, low, high = map(F.col, ("lo", "hi", "low", "high"))
    parts = parts.withColumn("bin", F.explode(F.sequence(A.bin_at(low, lo, hi, n), A.bin_at(high, lo, hi, n))))
    part = A.part(F.col("volume"), low, high, lo, hi, F.col("bin"), n)
    parts = parts.groupBy(*key, "stretch", F.greatest("i", "begin").alias("i"), "bin").agg(F.sum(part).alias("part"))
    grid = at.withColumns(edges).select(*key, "stretch", "i", "total", "slack", "__lo", "step", F.when(flat, F.col("lo")).alias("flat_price"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    grid = grid.join(parts, [*key, "stretch", "i", "bin"], "left")
    volume = F.sum(F.coalesce("part", F.lit(0).cast(A.EXACT))).over(Window.partitionBy(*key, "stretch", "bin").orderBy("i").rowsBetween(*UPTO))
    low = F.col("__lo") + F.col("bin") * F.col("step")
    binned = grid.where("total > 0").select(*KEY, F.struct("segment", "i").alias("segment"), F.col("i").alias("segment_end"), "total", "slack", "bin", volume.alias("volume"), low.alias("price_low"), (F.col("__lo") + (F.col("bin") + 1) * F.col("step")).alias("price_high"), F.coalesce("flat_price", F.col("__lo") + (F.col("bin") + 0.5) * F.col("step")).alias("price"))
    out = A.value_area(binned, share).select(*KEY, F.col("segment.segment").alias("segment"), F.col("segment.i").alias("cursor"), "total", "poc", "vah", "val")
    last = segmented.groupBy(*key).agg(F.max("i").alias("__end"))
    return out.join(last, key).withColumn("truncated", F.col("cursor") < F.col("__end")).drop("__end")


def line_ends(bars: DataFrame, lines: DataFrame, times: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """lines (anchor_i, cursor and more; they may overlap) with VWAP, deviation and bands at the cursor.

    Each different anchor runs once, over the bars up to the last cursor that
    asks for it, with sums of differences to its own first price: a difference
    of sums over the whole series would lose the deviation of a short line.
    Bars without volume show the value before them.
    """
    runs = lines.groupBy(*KEY, "anchor_i").agg(F.max("cursor").alias("__to"))
    at = within(bars.select(*KEY, "i", "high", "low", "close", "volume"), runs, "i", "anchor_i", "__to", 512).withColumn("segment", F.col("anchor_i"))
    w = Window.partitionBy(*KEY, "segment").orderBy("i").rowsBetween(*UPTO)
    held = {c: F.last(c, ignorenulls=True).over(w) for c in ("vwap", "sigma")}
    ends = A.vwap(at).withColumns(held).select(*KEY, "anchor_i", F.col("i").alias("cursor"), "vwap", "sigma")
    return A.bands(lines.join(ends, [*KEY, "anchor_i", "cursor"]).where("vwap is not null"), times)


def line_points(bars: DataFrame, lines: DataFrame, times: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Every bar of the lines, from anchor to cursor, as line_ends() has the last one; the bar is `cursor`, the line's own end `end_i`."""
    return line_ends(bars, lines.withColumn("end_i", F.col("cursor")).withColumn("cursor", F.explode(F.sequence("anchor_i", "cursor"))), times)


def live_ghost(bars: DataFrame, length: int = 50) -> DataFrame:
    """For each bar the last anchor known there (anchor_i, anchor_type, known_i; bar 0, "initial", before any) and the provisional
    extreme since (ghost_type, ghost_i, ghost_price, the latest bar on ties)."""
    found = pivots(bars.select(*KEY, "i", "time", "high", "low"), length, left_ties=True)
    known = found.groupBy(*KEY, F.col("confirmed_i").alias("i")).agg(F.max_by(F.struct(F.col("i").alias("anchor_i"), F.col("kind").alias("anchor_type"), F.col("confirmed_i").alias("known_i")), F.col("kind") == "low").alias("__a"))
    zero = F.struct(F.lit(0).alias("anchor_i"), F.lit("initial").alias("anchor_type"), F.lit(0).alias("known_i"))
    at = bars.select(*KEY, "i", "high", "low").join(known, [*KEY, "i"], "left").withColumn("a", F.coalesce(F.last("__a", ignorenulls=True).over(rows_between(*UPTO)), zero))
    falls = F.col("a.anchor_type") == "high"
    point = lambda p: F.struct(p.alias("p"), F.col("i"))
    at = at.withColumn("__h", point(F.col("high"))).withColumn("__l", point(-F.col("low")))
    # an anchor lies `length` bars before it is known: what came between is looked up once, then extremes run on
    for c in ("__h", "__l"):
        back = F.collect_list(c).over(rows_between(-(length - 1), 0))
        at = at.withColumn(c + "b", F.array_max(F.filter(back, lambda x: x["i"] > F.col("a.anchor_i"))))
    opens = (F.col("i") == F.col("a.known_i")) & (F.col("a.anchor_type") != "initial")
    mine = F.when(falls, F.when(opens, F.col("__lb")).otherwise(F.col("__l"))).otherwise(F.when(opens, F.col("__hb")).otherwise(F.col("__h")))
    at = at.withColumn("__m", F.when(F.col("i") > F.col("a.anchor_i"), mine))
    best = F.max("__m").over(Window.partitionBy(*KEY, "a").orderBy("i").rowsBetween(*UPTO))
    at = at.withColumn("b", best)
    return at.select(*KEY, F.col("i").alias("cursor"), "a.*", F.when(F.col("b").isNotNull(), F.when(falls, "low").otherwise("high")).alias("ghost_type"), F.col("b.i").alias("ghost_i"), F.when(falls, -F.col("b.p")).otherwise(F.col("b.p")).alias("ghost_price"))


def ghost_lines(bars: DataFrame, length: int = 50) -> DataFrame:
    """At every cursor the lines from the last confirmed anchor (ghost_regular_pivot) and from the live ghost (ghost_live)."""
    at = live_ghost(bars, length)
    fixed = F.struct(F.lit("ghost_regular_pivot").alias("source"), F.col("anchor_type").alias("pivot_type"), F.col("anchor_i"), F.col("known_i").alias("confirmed_i"))
    live = F.struct(F.lit("ghost_live").alias("source"), F.col("ghost_type").alias("pivot_type"), F.col("ghost_i").alias("anchor_i"), F.lit(None).cast("int").alias("confirmed_i"))
    both = F.array_compact(F.array(F.when(F.col("anchor_type") != "initial", fixed), F.when(F.col("ghost_i").isNotNull(), live)))
    return line_ends(bars, at.select(*KEY, "cursor", F.explode(both).alias("x")).select(*KEY, "cursor", "x.*"))


def missed_lines(bars: DataFrame, missed: DataFrame) -> DataFrame:
    """At every cursor the line from the missed pivot known last there (of those the latest bar, then low before high)."""
    found = missed.where("source = 'missed'").select(*KEY, "i", "kind", "price", "confirmed_i")
    at = as_of(bars.select(*KEY, F.col("i").alias("cursor")), found, "cursor", "confirmed_i", ["i", "kind", "price", "confirmed_i"], prefix="__").where("__i is not null")
    return line_ends(bars, at.select(*KEY, "cursor", F.col("__i").alias("anchor_i"), F.col("__kind").alias("pivot_type"), F.col("__price").alias("pivot_price"), F.col("__confirmed_i").alias("confirmed_i")))


def known_anchors(bars: DataFrame, events: DataFrame | None = None, *, session_seconds: int = 0, open_seconds: int = 34200, offset: int = 0) -> DataFrame:
    """Anchor bars with the bar at which each is known and their sources: session starts, market opens, structure breaks.

    A day without a bar at or after the open has its first bar as anchor, known when the next day begins.
    """
    local = F.col("time") + offset
    at = bars.withColumn("__s", ((local - session_seconds) / 86400).cast("long")).withColumn("__day", (local / 86400).cast("long")).withColumn("__sec", local - F.col("__day") * 86400)
    starts = at.groupBy(*KEY, "__s").agg(F.min("i").alias("i")).select(*KEY, "i", F.col("i").alias("known_i"), F.lit("session_start").alias("source"))
    days = at.groupBy(*KEY, "__day").agg(F.min("i").alias("first"), F.min(F.when(F.col("__sec") >= open_seconds, F.col("i"))).alias("open"))
    days = days.withColumn("next", F.lead("first").over(Window.partitionBy(*KEY).orderBy("__day")))
    opens = days.select(*KEY, F.coalesce("open", "first").alias("i"), F.coalesce("open", "next").alias("known_i"), F.lit("market_open").alias("source")).where("known_i is not null")
    out = starts.unionByName(opens)
    if events is not None:
        out = out.unionByName(events.select(*KEY, "i", F.col("i").alias("known_i"), F.lower("type").alias("source")))
    return out.groupBy(*KEY, "i").agg(F.min("known_i").alias("known_i"), F.sort_array(F.collect_set("source")).alias("sources"))


def lines_at(bars: DataFrame, anchors: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each cursor (column cursor) the lines of the anchors known there, each up to the bar before the next or the cursor.

    The result has a row for each cursor and line; VWAPs are looked up once for each different line.
    """
    known = cursors.join(anchors.select(*KEY, F.col("i").alias("anchor_i"), "known_i"), KEY).where("known_i <= cursor")
    following = F.lead("anchor_i").over(Window.partitionBy(*KEY, "cursor").orderBy("anchor_i"))
    lines = known.select(*KEY, F.col("cursor").alias("at"), "anchor_i", F.coalesce(following - 1, F.col("cursor")).alias("cursor"))
    return line_ends(bars, lines, ()).select(*KEY, F.col("at").alias("cursor"), "anchor_i", F.col("cursor").alias("end_i"), "vwap", "sigma")


def structure_at(bars: DataFrame, items: dict[str, DataFrame], events: DataFrame, external: DataFrame) -> DataFrame:
    """At every cursor how many items of each kind are known (n_<kind>) and, for items with an end_i, open (open_<kind>), the last
    structure break, and the major high and low with the middle between them.

    items: tables with known_i and, for those that end, end_i (null: open).
    """
    deltas = None
    for kind, rows in items.items():
        ends = "end_i" in rows.columns
        each = rows.select(*KEY, F.col("known_i").alias("i"), F.lit(kind).alias("kind"), F.lit(1).alias("known"), F.lit(1 if ends else 0).alias("open"))
        if ends:
            each = each.unionByName(rows.where("end_i is not null").select(*KEY, F.greatest("end_i", "known_i").alias("i"), F.lit(kind).alias("kind"), F.lit(0).alias("known"), F.lit(-1).alias("open")))
        deltas = each if deltas is None else deltas.unionByName(each)
    sums: list[Column] = []
    names = []
    for kind, rows in items.items():
        for column, name in (("known", f"n_{kind}"), *([("open", f"open_{kind}")] if "end_i" in rows.columns else [])):
            sums.append(F.sum(F.when(F.col("kind") == kind, F.col(column)).otherwise(0)).alias(name))
            names.append(name)
    steps = deltas.groupBy(*KEY, "i").agg(*sums)
    order = F.struct("i", (F.col("scope") == "external").alias("o"), (F.col("direction") == "bear").alias("d"))
    last_break = events.groupBy(*KEY, "i").agg(F.max_by(F.struct("type", "scope", "direction", "level"), order).alias("b"))
    major = external.groupBy(*KEY, F.col("confirmed_i").alias("i")).agg(*[F.max_by(F.when(F.col("kind") == k, F.col("price")), F.when(F.col("kind") == k, F.col("i"))).alias(f"m_{k}") for k in ("high", "low")])
    at = bars.select(*KEY, "i").join(steps, [*KEY, "i"], "left").join(last_break, [*KEY, "i"], "left").join(major, [*KEY, "i"], "left")
    upto = along().rowsBetween(*UPTO)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    out = at.select(*KEY, F.col("i").alias("cursor"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long").alias(c) for c in names], last("b").alias("b"), last("m_high").alias("major_high"), last("m_low").alias("major_low"))
    return out.select(*KEY, "cursor", *names, *[F.col(f"b.{c}").alias(f"last_{c}") for c in ("type", "scope", "direction", "level")], "major_high", "major_low", ((F.col("major_high") + F.col("major_low")) / 2).alias("equilibrium"))
