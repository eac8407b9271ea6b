"""Market structure: breaks, fair value gaps, order blocks, trendlines, trailing extremes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, along, fold_two, rows_between
from .joins import within

EVENT_SCHEMA = "type string, scope string, direction string, i int, level double, pivot_i int, pivot_confirmed_i int, previous_trend int"


def breaks(bars: DataFrame, found: DataFrame, scope: str) -> DataFrame:
    """BOS and CHOCH events: closes that cross the last confirmed pivot, each pivot once; CHOCH turns the trend."""

    def kernel(b: dict[str, np.ndarray], pivots: list[dict]) -> list[tuple]:
        close, out, trend, nxt = b["close"], [], 0, 0
        open_: dict[str, dict | None] = {"high": None, "low": None}
        for i in range(len(close)):
            while nxt < len(pivots) and pivots[nxt]["confirmed_i"] <= i:
                open_[pivots[nxt]["kind"]] = pivots[nxt]
                nxt += 1
            if not i:
                continue
            for kind, way, name in (("high", 1, "bull"), ("low", -1, "bear")):
                p = open_[kind]
                if p and way * close[i - 1] <= way * p["price"] < way * close[i]:
                    out.append(("CHOCH" if trend == -way else "BOS", scope, name, i, p["price"], p["i"], p["confirmed_i"], trend))
                    trend, open_[kind] = way, None
        return out

    return fold_two(bars.select(*KEY, "i", "close"), found.select(*KEY, "kind", "i", "price", "confirmed_i"), kernel, EVENT_SCHEMA, ["confirmed_i", "i"])


#: Weight of a liquidity event by its class (fixed values).
WEIGHTS = {"SWEEP": 0.90, "GRAB": 0.82, "BIG_GRAB": 0.88, "RUN": 0.85}


def boosted(events: DataFrame, found: DataFrame, window: int = 10) -> DataFrame:
    """events with the best liquidity event of the last `window` bars on the right side, as weight and class.

    A break that turns needs a raid of the other side, one that goes on a run of its own.
    """
    weight = F.coalesce(*[F.when(F.col("classification") == k, w) for k, w in WEIGHTS.items()])
    traded = (F.col("volume_score") > 0) & (F.col("volume_source") == "multi_timeframe_index")  # a bar's own volume tells nothing more
    weight = F.least(weight + F.when(traded, 0.05).otherwise(0.0), F.lit(0.95))
    signals = found.where("resolved_i is not null").select(*KEY, "side", "classification", "resolved_i", (F.col("resolved_i") + window).alias("__to"), weight.alias("w"))
    turn = F.col("type") == "CHOCH"
    want = F.when(turn == (F.col("direction") == "bull"), "sl").otherwise("sh")
    at = events.withColumn("__want", want)
    two = within(at.select(*KEY, "scope", "direction", "i", "type", "__want").where("scope = 'internal'"), signals, "i", "resolved_i", "__to")
    two = two.where((F.col("side") == F.col("__want")) & ((F.col("classification") == "RUN") != (F.col("type") == "CHOCH")))
    best = two.groupBy(*KEY, "scope", "direction", "i").agg(F.max_by(F.struct("w", "classification"), F.struct("w", "classification")).alias("b"))
    out = at.join(best, [*KEY, "scope", "direction", "i"], "left")
    return out.withColumn("boosted", F.col("b").isNotNull()).withColumn("probability_weight", F.coalesce("b.w", F.lit(0.5))).withColumn("liquidity_signal", F.col("b.classification")).drop("b", "__want")


def gaps(bars: DataFrame, auto_threshold: bool = True) -> DataFrame:
    """Fair value gaps: three bars that leave a gap, the middle one's body above twice the mean body before it."""
    at = lambda c, k: F.lag(c, k).over(along())  # noqa: E731  negative: the bar after
    body = F.when((F.col("open") != 0) & at("low", 1).isNotNull() & at("low", -1).isNotNull(), (F.col("close") - F.col("open")) / F.abs("open"))
    out = bars.withColumn("delta", body).withColumn("lh", at("high", 1)).withColumn("ll", at("low", 1)).withColumn("rh", at("high", -1)).withColumn("rl", at("low", -1))
    mean = F.coalesce(2 * F.avg(F.abs("delta")).over(rows_between(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("threshold", mean if auto_threshold else F.lit(0.0)).where("delta is not null")
    bull = (F.col("rl") > F.col("lh")) & (F.col("close") > F.col("lh")) & (F.col("delta") > F.col("threshold"))
    bear = (F.col("rh") < F.col("ll")) & (F.col("close") < F.col("ll")) & (-F.col("delta") > F.col("threshold"))
    out = out.withColumn("direction", F.when(bull, "bull").when(bear, "bear")).where("direction is not null")
    top = F.when(F.col("direction") == "bull", F.col("rl")).otherwise(F.col("ll"))
    bottom = F.when(F.col("direction") == "bull", F.col("lh")).otherwise(F.col("rh"))
    return out.select(*KEY, "i", (F.col("i") + 1).cast("int").alias("confirmed_i"), "direction", top.alias("top"), bottom.alias("bottom"))


def with_reaction(zones: DataFrame, found: DataFrame) -> DataFrame:
    """Gaps with high_reaction: a raid resolved on the bar that formed it or the one before."""
    raids = found.where(F.col("classification").isin("SWEEP", "GRAB", "BIG_GRAB")).select(*KEY, F.explode(F.array("resolved_i", F.col("resolved_i") + 1)).alias("confirmed_i")).distinct()
    hit = raids.withColumn("high_reaction", F.lit(True))
    return zones.join(hit, [*KEY, "confirmed_i"], "left").withColumn("high_reaction", F.coalesce("high_reaction", F.lit(False)))


LIFE_SCHEMA = "zone long, first_touch_i int, end_i int, fill_ratio double, fills array<struct<i:int,fill_ratio:double>>"


def lifecycle(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """zones (i, confirmed_i, direction, top, bottom, …) with their fills after confirmation, up to a whole one (end_i).

    Open zones wait in the order of their near edge, so a bar visits only the
    zones that it enters.
    """
    # numbered by all columns: zones alike in all of them have one life, whichever has which number
    extra = zones.withColumn("zone", F.row_number().over(Window.partitionBy(*KEY).orderBy(*[c for c in zones.columns if c not in KEY])).cast("long"))

    def kernel(b: dict[str, np.ndarray], rows: list[dict]) -> list[tuple]:
        import bisect

        high, low = b["high"], b["low"]
        open_: dict[str, list[tuple[float, int]]] = {"bull": [], "bear": []}
        state = [[None, None, 0.0, []] for _ in rows]
        nxt = 0
        for i in range(len(high)):
            for way, reach in (("bull", -low[i]), ("bear", high[i])):
                waiting = open_[way]  # keys: the near edge, ascending, as the bar's reach sees it
                entered = bisect.bisect_left(waiting, (reach, -1))
                done = []
                for _, z in waiting[:entered]:
                    r, s = rows[z], state[z]
                    size = r["top"] - r["bottom"]
                    depth = min(1.0, max(0.0, ((r["top"] - low[i]) if way == "bull" else (high[i] - r["bottom"])) / size))
                    if (low[i] <= r["bottom"]) if way == "bull" else (high[i] >= r["top"]):
                        depth = 1.0
                    if depth > 0 and s[0] is None:
                        s[0] = i
                    if depth > s[2]:
                        s[2] = depth
                        s[3].append({"i": i, "fill_ratio": depth})
                    if depth >= 1:
                        s[1] = i
                        done.append(z)
                if done:
                    gone = set(done)
                    open_[way] = [x for x in waiting if x[1] not in gone]
            while nxt < len(rows) and rows[nxt]["confirmed_i"] <= i:
                r = rows[nxt]
                if r["top"] > r["bottom"]:
                    bisect.insort(open_[r["direction"]], (-r["top"] if r["direction"] == "bull" else r["bottom"], nxt))
                nxt += 1
        return [(r["zone"], *s) for r, s in zip(rows, state, strict=True)]

    life = fold_two(bars.select(*KEY, "i", "high", "low"), extra.select(*KEY, "zone", "confirmed_i", "direction", "top", "bottom"), kernel, LIFE_SCHEMA, ["confirmed_i", "zone"])
    out = extra.join(life, [*KEY, "zone"]).drop("zone")
    return out.withColumn("status", F.when(F.col("end_i").isNull(), "active").otherwise("mitigated"))


def order_blocks(bars: DataFrame, events: DataFrame, bucket: int = 64) -> DataFrame:
    """For each break the most extreme bar from its pivot to it: the first lowest (bull) or highest (bear)."""
    spans = events.where("pivot_i > 0 and i >= pivot_i").select(*KEY, "type", "scope", "direction", F.col("i").alias("triggered_by"), "pivot_i", *[c for c in ("boosted", "probability_weight") if c in events.columns])
    two = within(bars.select(*KEY, "i", "high", "low"), spans, "i", "pivot_i", "triggered_by", bucket)
    best = F.min_by(F.struct("i", F.col("high").alias("top"), F.col("low").alias("bottom")), F.struct(F.when(F.col("direction") == "bull", F.col("low")).otherwise(-F.col("high")).alias("x"), F.col("i")))
    out = two.groupBy(*[c for c in spans.columns if c not in ("pivot_i",)], "pivot_i").agg(best.alias("b"))
    return out.select(*[c for c in spans.columns if c != "pivot_i"], F.col("b.i").alias("i"), F.col("b.top").alias("top"), F.col("b.bottom").alias("bottom"), F.col("triggered_by").alias("confirmed_i"))


def relevance(blocks: DataFrame, bars: DataFrame) -> DataFrame:
    """Order blocks with zone_range_ratio, displacement, volume_ratio, relevance_score and relevant."""
    real = F.col("high") > F.col("low")
    frame = rows_between(-20, 0)
    means = bars.select(*KEY, "i", F.avg(F.when(real, F.col("high") - F.col("low"))).over(frame).alias("__range"), F.avg(F.when(real, F.col("volume"))).over(frame).alias("__volume"))
    trigger = bars.select(*KEY, F.col("i").alias("triggered_by"), F.col("close").alias("__close"), F.col("volume").alias("__v"))
    at = blocks.join(means, [*KEY, "i"]).join(trigger, [*KEY, "triggered_by"])
    height = F.abs(F.col("top") - F.col("bottom"))
    at = at.withColumn("average_range", F.greatest(F.coalesce(F.when(F.col("__range") > 0, F.col("__range")), height), F.lit(1e-12)))
    at = at.withColumn("zone_range_ratio", height / F.col("average_range")).withColumn("displacement", F.abs(F.col("__close") - (F.col("top") + F.col("bottom")) / 2) / F.col("average_range"))
    at = at.withColumn("volume_ratio", F.coalesce(F.when(F.col("__volume") > 0, F.col("__v") / F.col("__volume")), F.lit(1.0)))
    outer = F.col("scope") == "external"
    own = lambda c, default: F.col(c) if c in blocks.columns else F.lit(default)
    score = F.least(F.col("displacement"), F.lit(4.0)) * 0.70 + F.least(F.col("zone_range_ratio"), F.lit(1.5)) * 0.45 + F.least(F.col("volume_ratio"), F.lit(3.0)) * 0.20 + F.when(outer, 1.25).otherwise(0.0) + F.when(own("boosted", False), 0.5).otherwise(0.0) + own("probability_weight", 0.5) * 0.30
    ok = F.when(outer, (F.col("zone_range_ratio") >= 0.20) & (F.col("displacement") >= 1.0)).otherwise((F.col("zone_range_ratio") >= 0.25) & (F.col("displacement") >= 1.5))
    return at.withColumn("relevance_score", score).withColumn("relevant", ok).drop("__range", "__volume", "__close", "__v")


def trendlines(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Lines through highs that fall or lows that rise, and the first close beyond each after it is known (break_i)."""
    before = lambda c: F.lag(c).over(along("kind"))
    lines = found.select(*KEY, "kind", before("i").alias("from_i"), before("price").alias("from_price"), F.col("i").alias("to_i"), F.col("price").alias("to_price"), "confirmed_i")
    falling, rising = (F.col("kind") == "high") & (F.col("to_price") < F.col("from_price")), (F.col("kind") == "low") & (F.col("to_price") > F.col("from_price"))
    lines = lines.where(F.col("from_i").isNotNull() & (falling | rising)).withColumn("direction", F.when(F.col("kind") == "high", "bear").otherwise("bull"))
    lines = lines.withColumn("slope", (F.col("to_price") - F.col("from_price")) / (F.col("to_i") - F.col("from_i")))

    def kernel(b: dict[str, np.ndarray], rows: list[dict]) -> list[tuple]:
        close, out = b["close"], []
        step = 256
        for r in rows:
            lo, hit = r["confirmed_i"] + 1, None
            while lo < len(close) and hit is None:
                j = np.arange(lo, min(lo + step, len(close)))
                line = r["to_price"] + r["slope"] * (j - r["to_i"])
                beyond = np.flatnonzero(close[j] > line if r["direction"] == "bear" else close[j] < line)
                hit, lo = (int(j[beyond[0]]) if len(beyond) else None), lo + step
            out.append((r["direction"], r["from_i"], r["from_price"], r["to_i"], r["to_price"], r["slope"], r["confirmed_i"], hit))
        return out

    return fold_two(bars.select(*KEY, "i", "close"), lines, kernel, "direction string, from_i int, from_price double, to_i int, to_price double, slope double, confirmed_i int, break_i int", ["to_i", "kind"])


def trailing(bars: DataFrame, external: DataFrame, events: DataFrame, cursor: int | None = None) -> DataFrame:
    """The last external high and low known before the cursor, moved on by later extremes, and which of them is strong."""
    end = bars.groupBy(*KEY).agg(F.max("i").alias("__last"))
    end = end.withColumn("__c", F.col("__last") if cursor is None else F.least(F.lit(cursor), F.col("__last")))
    known = external.join(end, KEY).where(F.col("confirmed_i") < F.col("__c"))
    last = known.groupBy(*KEY, "__c").agg(*[F.max_by(F.when(F.col("kind") == k, F.struct("i", "price", "confirmed_i")), F.when(F.col("kind") == k, F.struct("confirmed_i", "i"))).alias(k) for k in ("high", "low")]).where("high is not null and low is not null")
    later = lambda k: F.when(F.col("i") > F.col(f"{k}.confirmed_i"), F.col(k + "_"))
    at = bars.select(*KEY, "i", F.col("high").alias("high_"), F.col("low").alias("low_")).join(last, KEY).where(F.col("i") <= F.col("__c"))
    ext = at.groupBy(*KEY, "__c", "high", "low").agg(
        F.max(F.when(later("high").isNotNull(), F.struct(F.col("high_").alias("p"), F.col("i")))).alias("t"),
        F.min(F.when(later("low").isNotNull(), F.struct(F.col("low_").alias("p"), (-F.col("i")).alias("i")))).alias("b"),
    )
    up = F.coalesce(F.col("t.p") >= F.col("high.price"), F.lit(False))
    down = F.coalesce(F.col("b.p") <= F.col("low.price"), F.lit(False))
    bias = events.where("scope = 'external'").join(end, KEY).where(F.col("i") < F.col("__c")).groupBy(*KEY).agg(F.max_by("direction", F.struct("i", (F.col("type") == "CHOCH").alias("x"), (F.col("direction") == "bear").alias("y"))).alias("d"))
    out = ext.join(bias, KEY, "left").withColumn("bias", F.coalesce(F.when(F.col("d") == "bull", "bullish").when(F.col("d") == "bear", "bearish"), F.lit("neutral")))
    return out.select(
        *KEY, F.when(up, F.col("t.p")).otherwise(F.col("high.price")).alias("top"), F.when(up, F.col("t.i")).otherwise(F.col("high.i")).alias("top_i"),
        F.when(down, F.col("b.p")).otherwise(F.col("low.price")).alias("bottom"), F.when(down, -F.col("b.i")).otherwise(F.col("low.i")).alias("bottom_i"), "bias",
        F.when(F.col("bias") == "bearish", "strong_high").otherwise("weak_high").alias("high_class"), F.when(F.col("bias") == "bullish", "strong_low").otherwise("weak_low").alias("low_class"),
    )


def major_levels(external: DataFrame, cursor: int) -> DataFrame:
    """The latest external high and low known at the cursor and the middle between them (premium above, discount below)."""
    known = external.where(F.col("confirmed_i") <= cursor)
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("price")), F.when(F.col("kind") == k, F.struct("confirmed_i", "i")))
    return known.groupBy(*KEY).agg(last("high").alias("major_high"), last("low").alias("major_low")).withColumn("equilibrium", (F.col("major_high") + F.col("major_low")) / 2)


def active_zones(zones: DataFrame, cursor: int, newest: int) -> DataFrame:
    """Zones of a lifecycle that are open at the cursor, cut back by their fills so far, newest first."""
    known = zones.where((F.col("confirmed_i") <= cursor) & (F.col("end_i").isNull() | (F.col("end_i") > cursor)))
    fill = F.aggregate(F.filter("fills", lambda x: x["i"] <= cursor), F.lit(0.0), lambda a, x: F.greatest(a, x["fill_ratio"]))
    known = known.withColumn("fill_ratio", fill)
    cut = (F.col("top") - F.col("bottom")) * F.col("fill_ratio")
    bull = F.col("direction") == "bull"
    known = known.withColumns({"top": F.when(bull, F.col("top") - cut).otherwise(F.col("top")), "bottom": F.when(~bull, F.col("bottom") + cut).otherwise(F.col("bottom"))})
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confirmed_i"), F.desc("i"), "direction"))
    return known.withColumn("place", place).where(F.col("place") <= newest)


def with_matched_reaction(zones: DataFrame, found: DataFrame, bars: int = 12) -> DataFrame:
    """Gaps with a raid of the matching side (bull: lows) within some bars after they formed."""
    raids = found.where(F.col("classification").isin("SWEEP", "GRAB", "BIG_GRAB")).select(*KEY, "side", F.col("resolved_i").alias("__r"))
    spans = zones.select(*KEY, "i", "direction", F.col("confirmed_i").alias("__f"), (F.col("confirmed_i") + bars).alias("__t"), F.when(F.col("direction") == "bull", "sl").otherwise("sh").alias("__side"))
    hit = within(raids, spans, "__r", "__f", "__t").where("side = __side").select(*KEY, "i", "direction").distinct().withColumn("reacted", F.lit(True))
    return zones.join(hit, [*KEY, "i", "direction"], "left").withColumn("reacted", F.coalesce("reacted", F.lit(False)))
