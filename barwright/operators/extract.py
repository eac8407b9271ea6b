"""The feature extract: one row for each ghost event, with its place among everything known then on three timeframes.

All timeframes are bars of one table, keyed by (symbol, tf), so every indicator
runs once over all of them. What an event may see on a timeframe is what was
known at the last bar that has *ended* by then (the cursor): spans (zones,
levels, events) carry the bar they become known at and the bar they end at, and
one sweep finds the nearest of each kind for all events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import channels as C
from . import features as X
from . import levels as Z
from . import liquidity as L
from . import pivots as P
from . import profile as A
from . import series as V
from . import strategy as T
from . import structure as S
from .bars import PRICES, with_index
from .core import KEY
from .joins import as_of, nearest_open, within
from .scratch import kept

TIMEFRAMES = (1, 10, 60)
METADATA = ("event_id", "event_timestamp", "event_date", "event_hour", "event_minute", "event_index", "ghost_index", "complete")
#: Features of one timeframe, without their prefix tf<minutes>_ (fixed names).
OF_TIMEFRAME = (
    "ob_dist_pips", "ob_width_pips", "fvg_dist_pips", "fvg_width_pips", "fib_dist_pips", "vwap_dist_pips", "vwap_band1_dist_pips", "vwap_band2_dist_pips", "vp_poc_dist_pips", "vp_vah_dist_pips", "vp_val_dist_pips",
    "bos_choch_dist_pips", "eqh_eql_dist_pips", "sweep_grab_run_dist_pips", "supply_demand_dist_pips", "supply_demand_width_pips", "channel_dist_pips", "channel_width_pips",
)
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
#: Structure breaks and resolved levels are seen for so many bars.
LOOKBACK = 500


def feature_columns(timeframes: Sequence[int] = TIMEFRAMES) -> list[str]:
    own = [f"tf{tf}_{name}" for tf in timeframes for name in OF_TIMEFRAME]
    return ["ghost_price", "ghost_hlc3", "atr_1m", "volume_1m", "volume_ema9_1m", *own, "sr_4h_dist_pips", "sr_d_dist_pips", "sr_w_dist_pips", "ghost_type", "relocation"]


def target_columns(horizons: Sequence[int] = X.HORIZONS) -> list[str]:
    return [f"Y_{n}m" for n in horizons]


def frames(minutes: DataFrame, timeframes: Sequence[int] = TIMEFRAMES, offset: int = 0) -> DataFrame:
    """Bars of all timeframes, aligned to local time, with end_time."""
    span = F.col("tf") * 60
    each = minutes.drop("tf", "i").withColumn("tf", F.explode(F.array(*map(F.lit, timeframes))))
    each = each.withColumn("__t", F.floor((F.col("time") + offset) / span) * span - offset)
    ohlcv = [F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")]
    out = with_index(each.groupBy("symbol", "tf", "__t").agg(*ohlcv).withColumnRenamed("__t", "time").select("symbol", "tf", "time", *PRICES, "volume"))
    return out.withColumn("end_time", F.col("time") + F.col("tf") * 60)


def spans(bars: DataFrame, *, k: int = 3, external_k: int = 10) -> DataFrame:
    """What is nearest to a price: kind, value, tie (the greater is taken), width, first and last bar at which it is seen.

    bars need column atr_late. Kinds: ob, fvg, supply_demand (middles of zones,
    the later confirmed on ties); structure, resolved, equal (prices, the higher on ties).
    """
    inner, outer = P.pivots(bars, k), P.pivots(bars, external_k)
    events = kept(S.breaks(bars, inner, "internal").unionByName(S.breaks(bars, outer, "external")), "breaks")
    blocks = kept(S.lifecycle(bars, S.order_blocks(bars, events)).drop("fills"), "blocks")
    levels = kept(L.levels(bars, k, external_k), "levels")
    equal = L.with_equals(levels, L.equal_levels(levels.select(*KEY, "side", "i", "price", "confirmed_i"), bars)).where("(is_eqh or is_eql) and eq_confirmed_i is not null")

    def zone(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(*KEY, F.lit(kind).alias("kind"), ((F.col("top") + F.col("bottom")) / 2).alias("value"), F.col("confirmed_i").cast("double").alias("tie"), F.abs(F.col("top") - F.col("bottom")).alias("width"), F.col("confirmed_i").alias("first"), (F.col("end_i") - 1).alias("last"))

    def price(rows: DataFrame, kind: str, value: Column, first: str, last: Column) -> DataFrame:
        return rows.select(*KEY, F.lit(kind).alias("kind"), value.alias("value"), value.alias("tie"), F.lit(0.0).alias("width"), F.col(first).alias("first"), last.alias("last"))

    out = zone(blocks, "ob").unionByName(zone(S.lifecycle(bars, S.gaps(bars)), "fvg")).unionByName(zone(T.supply_demand(blocks, bars), "supply_demand"))
    out = out.unionByName(price(events, "structure", F.col("level"), "i", F.col("i") + LOOKBACK))
    out = out.unionByName(price(levels.where("classification is not null and resolved_i is not null"), "resolved", F.col("price"), "resolved_i", F.col("resolved_i") + LOOKBACK))
    return out.unionByName(price(equal, "equal", F.coalesce("eq_price", "price"), "eq_confirmed_i", F.col("swept_i") - 1))


def alternation(outer: DataFrame) -> DataFrame:
    """At each bar where pivots become known, the last of them and the last of the other kind before it."""
    w = Window.partitionBy(*KEY).orderBy("confirmed_i", "i", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.struct("i", "price")), ignorenulls=True).over(w)
    at = outer.withColumn("h", last("high")).withColumn("l", last("low"))
    mine, other = F.when(F.col("kind") == "high", F.col("h")).otherwise(F.col("l")), F.when(F.col("kind") == "high", F.col("l")).otherwise(F.col("h"))
    at = at.select(*KEY, "confirmed_i", F.struct("i", "kind").alias("o"), mine.alias("m"), other.alias("p"))
    at = at.groupBy(*KEY, "confirmed_i").agg(F.max_by(F.struct("m", "p"), "o").alias("x"))
    return at.select(*KEY, "confirmed_i", F.col("x.m.i").alias("latest_i"), F.col("x.m.price").alias("latest_price"), F.col("x.p.i").alias("previous_i"), F.col("x.p.price").alias("previous_price"))


def _nearest_of(prices: list[Column], ref: Column) -> Column:
    """The nearest of a few prices, the higher on ties, null if all are null."""
    each = F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.abs(p - ref).alias("d"), (-p).alias("n"))) for p in prices]))
    return -F.array_min(each)["n"]


def _support_resistance(minutes: DataFrame, events: DataFrame, offset: int) -> DataFrame:
    """events with r_<name> and s_<name>: high and low of the local group of bars before theirs."""
    keys = {"4h": lambda t: F.floor((t + offset) / 14400), "d": lambda t: Z.period_key(t, "D", offset), "w": lambda t: Z.period_key(t, "W", offset)}
    for name, key in keys.items():
        groups = minutes.groupBy("symbol", key(F.col("time")).alias("__g")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
        w = Window.partitionBy("symbol").orderBy("__g")
        before = groups.select("symbol", "__g", F.lag("h").over(w).alias(f"r_{name}"), F.lag("l").over(w).alias(f"s_{name}"))
        events = events.withColumn("__g", key(F.col("event_time"))).join(before, ["symbol", "__g"], "left").drop("__g")
    return events


def extract(minutes: DataFrame, *, timeframes: Sequence[int] = TIMEFRAMES, pip: float = X.PIP, ghost_length: int = 50, k: int = 3, external_k: int = 10, bins: int = 50, channel_atr_share: float = 0.005, offset: int = 0, include_incomplete: bool = False) -> DataFrame:
    """symbol, the metadata, 64 features and 4 targets of each ghost event of one-minute bars, by their fixed names.

    An event without an ATR is left out, and one whose last horizon isn't over
    unless include_incomplete. `offset` is that of local time, in seconds. A
    timeframe of which no bar has ended yet has null features.
    """
    bars = kept(V.indicators(frames(minutes, timeframes, offset)).select(*KEY, "i", "time", *PRICES, "volume", "atr", "atr_late", "ema_volume"), "frames")
    bars = bars.withColumn("end_time", F.col("time") + F.col("tf") * 60)
    finest = bars.where(F.col("tf") == 1)
    own = finest.select(*KEY, F.col("i").alias("event_i"), F.col("atr").alias("atr_1m"), F.col("volume").alias("volume_1m"), F.col("ema_volume").alias("volume_ema9_1m"))
    serial = F.row_number().over(Window.partitionBy(*KEY).orderBy("event_i")) - 1
    events = X.labels(P.ghost_trace(finest.drop("end_time"), ghost_length), finest).withColumn("serial", serial)
    events = X.reference_price(events, finest).join(own, [*KEY, "event_i"]).where("atr_1m is not null and volume_ema9_1m is not null")
    events = kept(events if include_incomplete else events.where("complete"), "events")

    points = events.select("symbol", "event_i", "event_time", "ref", F.explode(F.array(*map(F.lit, timeframes))).alias("tf"))
    points = kept(as_of(points, bars, "event_time", "end_time", ["i"], prefix="cursor_").where("cursor_i is not null").withColumnRenamed("cursor_i", "cursor"), "cursors")
    near = nearest_open(points.select(*KEY, "event_i", "cursor", "ref"), spans(bars, k=k, external_k=external_k), point="event_i", at="cursor", ref="ref")
    wide = near.groupBy(*KEY, "event_i").agg(*[F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("ob", "fvg", "supply_demand", "structure", "resolved", "equal") for c in ("value", "width")])
    at = as_of(points, alternation(P.pivots(bars, external_k)), "cursor", "confirmed_i", ["latest_i", "latest_price", "previous_i", "previous_price"])
    at = at.join(wide, [*KEY, "event_i"], "left")

    lines = A.range_vwap(bars, at.where("previous_i is not null").select(*KEY, F.col("previous_i").alias("first"), F.col("cursor").alias("last")).distinct())
    at = at.join(lines.select(*KEY, F.col("first").alias("previous_i"), F.col("last").alias("cursor"), "vwap", "sigma"), [*KEY, "previous_i", "cursor"], "left")
    low_i, high_i = F.least("previous_i", "latest_i"), F.greatest("previous_i", "latest_i")
    at = at.withColumn("__first", F.when(F.col("previous_i").isNotNull(), low_i)).withColumn("__last", F.when(F.col("previous_i").isNotNull(), high_i))
    legs = at.where("__first is not null").select(*KEY, F.col("__first").alias("first"), F.col("__last").alias("last")).distinct()
    areas = A.range_profile(bars, legs, bins)
    at = at.join(areas.select(*KEY, F.col("first").alias("__first"), F.col("last").alias("__last"), "poc", "vah", "val"), [*KEY, "__first", "__last"], "left")

    found = C.three_low_channels(bars, P.pivots(bars, k), atr_share=channel_atr_share).withColumn("__to", F.col("break_i") - 1)
    met = within(points.select(*KEY, "event_i", "cursor", "ref"), found.select(*KEY, "base_i", "base_price", "slope", "width", "confirmed_i", "__to"), "cursor", "confirmed_i", "__to", 512)
    lower = F.col("base_price") + F.col("slope") * (F.col("cursor") - F.col("base_i"))
    met = met.withColumn("lower", lower).withColumn("upper", F.col("lower") + F.col("width"))
    nearer = F.struct(F.least(F.abs(F.col("lower") - F.col("ref")), F.abs(F.col("upper") - F.col("ref"))).alias("d"), "confirmed_i", "base_i")
    best = met.groupBy(*KEY, "event_i").agg(F.min_by(F.struct("lower", "upper", "width"), nearer).alias("channel"))
    at = at.join(best, [*KEY, "event_i"], "left")

    ref = F.col("ref")
    pips = lambda value: X.signed_pips(value, ref) * (X.PIP / pip)
    size = F.abs(F.col("latest_price") - F.col("previous_price"))
    fib = [F.least("latest_price", "previous_price") + size * r for r in RATIOS]
    values = {f"{out}_dist_pips": pips(F.col(f"{kind}_value")) for out, kind in (("ob", "ob"), ("fvg", "fvg"), ("bos_choch", "structure"), ("eqh_eql", "equal"), ("sweep_grab_run", "resolved"), ("supply_demand", "supply_demand"))}
    values |= {f"{kind}_width_pips": F.col(f"{kind}_width") / pip for kind in ("ob", "fvg", "supply_demand")}
    values |= {"fib_dist_pips": pips(F.when(F.col("previous_i").isNotNull(), _nearest_of(fib, ref))), "vwap_dist_pips": pips(F.col("vwap"))}
    values |= {f"vwap_band{n}_dist_pips": pips(_nearest_of([F.col("vwap") - n * F.col("sigma"), F.col("vwap") + n * F.col("sigma")], ref)) for n in (1, 2)}
    values |= {f"vp_{c}_dist_pips": pips(F.col(c)) for c in ("poc", "vah", "val")}
    values |= {"channel_dist_pips": pips(_nearest_of([F.col("channel.lower"), F.col("channel.upper")], ref)), "channel_width_pips": F.abs("channel.width") / pip}
    rows = at.select(*KEY, "event_i", F.struct(*[values[name].alias(name) for name in OF_TIMEFRAME]).alias("x"))
    rows = rows.groupBy("symbol", "event_i").agg(*[F.max(F.when(F.col("tf") == tf, F.col("x"))).alias(f"tf{tf}") for tf in timeframes])
    out = _support_resistance(finest, events, offset).join(rows, ["symbol", "event_i"], "left")
    local = F.col("event_time") + offset
    told = {
        "event_id": F.concat_ws("_", F.lit("ghost_relocated"), "ghost_type", "event_i", "ghost_i", "serial"), "event_timestamp": F.col("event_time"), "event_date": F.date_from_unix_date(F.floor(local / 86400).cast("int")).cast("string"),
        "event_hour": F.floor(F.pmod(local, F.lit(86400)) / 3600).cast("int"), "event_minute": F.floor(F.pmod(local, F.lit(3600)) / 60).cast("int"), "event_index": F.col("event_i"), "ghost_index": F.col("ghost_i"), "complete": F.col("complete"),
        "ghost_hlc3": ref,
    }
    told |= {f"tf{tf}_{name}": F.col(f"tf{tf}.{name}") for tf in timeframes for name in OF_TIMEFRAME}
    told |= {f"sr_{name}_dist_pips": pips(_nearest_of([F.col(f"r_{name}"), F.col(f"s_{name}")], ref)) for name in ("4h", "d", "w")}
    columns = [*METADATA, *feature_columns(timeframes), *target_columns()]
    return out.select("symbol", *[told.get(c, F.col(c)).alias(c) for c in columns])
