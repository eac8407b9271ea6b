"""Pivots and zigzags. Every row has the bar where it lies (i) and the bar where it is known (confirmed_i)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import along, fold, rows_between


def _beats(price: str, k: int, high: bool, left_ties: bool) -> Column:
    best = F.max if high else F.min
    left, right = best(price).over(rows_between(-k, -1)), best(price).over(rows_between(1, k))
    after = F.col(price) > right if high else F.col(price) < right
    if left_ties:
        before = F.col(price) >= left if high else F.col(price) <= left
    else:
        before = F.col(price) > left if high else F.col(price) < left
    return before & after


def pivots(bars: DataFrame, k: int, left_ties: bool = False) -> DataFrame:
    """Bars that beat the k bars on each side: kind high or low, i, price, confirmed_i = i + k.

    left_ties lets earlier bars equal the pivot; later ones never may.
    """
    at = bars.withColumn("__n", F.count(F.lit(1)).over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = at.withColumn("__high", _beats("high", k, True, left_ties)).withColumn("__low", _beats("low", k, False, left_ties))
    inside = (F.col("i") >= k) & (F.col("i") + k < F.col("__n"))
    one = lambda kind: F.when(F.col(f"__{kind}"), F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("price")))
    both = at.where(inside).withColumn("p", F.explode(F.array_compact(F.array(one("high"), one("low")))))
    return both.select("symbol", "tf", F.col("p.kind").alias("kind"), "i", "time", F.col("p.price").alias("price"), (F.col("i") + k).alias("confirmed_i"))


def adaptive_depth(n: int, configured: int, k: int) -> int:
    """The external depth of a series of n bars: at most n / 8, at least k + 2."""
    configured = k + 2 if configured <= k else configured
    return min(configured, max(n // 8, k + 2))


def scoped(internal: DataFrame, external: DataFrame) -> DataFrame:
    """internal pivots with scope and scope_confirmed_i, external where the deeper pivots have them too."""
    deep = external.select("symbol", "tf", "kind", "i", F.col("confirmed_i").alias("__c"))
    out = internal.join(deep, ["symbol", "tf", "kind", "i"], "left")
    return out.withColumn("scope", F.when(F.col("__c").isNull(), "internal").otherwise("external")).withColumn("scope_confirmed_i", F.coalesce("__c", "confirmed_i")).drop("__c")


PIVOT_SCHEMA = "kind string, i int, price double, confirmed_i int"


def compress(found: DataFrame, cursor: int | None = None) -> DataFrame:
    """Alternating pivots: of two of a kind the more extreme (later on ties), of two at a bar the larger move."""
    if cursor is not None:
        found = found.where((F.col("i") <= cursor) & (F.col("confirmed_i") <= cursor))

    def kernel(p: dict[str, np.ndarray]) -> dict:
        # runs of one kind give their extreme first; the second pivot of a bar is a run of its own, as it may win over the first
        way, at, price = np.where(p["kind"] == "high", 1, -1), p["i"], p["price"]
        doubled = np.concatenate([[False], at[1:] == at[:-1]])[: len(at)]
        starts = np.concatenate([[True], (way[1:] != way[:-1]) | doubled[:-1]])[: len(at)]
        run = np.cumsum(starts)
        best = np.lexsort((at, way * price, run))[np.flatnonzero(np.diff(run, append=run[-1:] + 1))]
        kept: list[int] = []
        for k in best:
            move = lambda x: abs(price[x] - price[kept[-2]]) if len(kept) > 1 else 0.0
            if not kept or (way[k] != way[kept[-1]] and at[k] != at[kept[-1]]):
                kept.append(k)
            elif way[k] * (price[k] - price[kept[-1]]) >= 0 if way[k] == way[kept[-1]] else move(k) > move(kept[-1]):
                kept[-1] = k
        return {c: p[c][kept] for c in ("kind", "i", "price", "confirmed_i")}

    return fold(found.select("symbol", "tf", "kind", "i", "price", "confirmed_i"), kernel, PIVOT_SCHEMA, ["i", "kind", "price"])


def labelled(zigzag: DataFrame) -> DataFrame:
    """HH, LH, HL or LL against the pivot of the same kind before; a first or equal one is LH or LL."""
    above = F.coalesce(F.col("price") > F.lag("price").over(along("kind")), F.lit(False))
    return zigzag.withColumn("label", F.when(F.col("kind") == "high", F.when(above, "HH").otherwise("LH")).otherwise(F.when(above, "HL").otherwise("LL")))


def segments(zigzag: DataFrame) -> DataFrame:
    """Legs between pivots that follow each other."""
    before = lambda c: F.lag(c).over(along())
    out = zigzag.select("symbol", "tf", before("i").alias("from_i"), before("price").alias("from_price"), F.col("i").alias("to_i"), F.col("price").alias("to_price"), "confirmed_i")
    return out.where("from_i is not null and from_i <> to_i").withColumn("direction", F.when(F.col("to_price") >= F.col("from_price"), "bull").otherwise("bear"))


def developing(zigzag: DataFrame, bars: DataFrame, cursor: int) -> DataFrame:
    """The opposite extreme after the last pivot up to the cursor (the later one on ties), not yet confirmed."""
    last = zigzag.groupBy("symbol", "tf").agg(F.max_by(F.struct("kind", "i"), "i").alias("last"))
    at = bars.join(last, ["symbol", "tf"]).where((F.col("i") > F.col("last.i")) & (F.col("i") <= cursor))
    low = F.max_by(F.struct("i", F.col("low").alias("price")), F.struct((-F.col("low")).alias("x"), F.col("i")))
    high = F.max_by(F.struct("i", F.col("high").alias("price")), F.struct(F.col("high").alias("x"), F.col("i")))
    out = at.groupBy("symbol", "tf", F.col("last.kind").alias("after")).agg(low.alias("low"), high.alias("high"))
    best = F.when(F.col("after") == "high", F.col("low")).otherwise(F.col("high"))
    return out.select("symbol", "tf", F.when(F.col("after") == "high", "low").otherwise("high").alias("kind"), best["i"].alias("i"), best["price"].alias("price"), F.lit(cursor).alias("confirmed_i"))


def closed_and_active(zigzag: DataFrame, bars: DataFrame, cursor: int) -> DataFrame:
    """Legs between known pivots, and the one from the last pivot to the extreme so far (active)."""
    last = zigzag.groupBy("symbol", "tf").agg(F.max_by(F.struct("i", "price"), "i").alias("p"))
    open_ = developing(zigzag, bars, cursor).join(last, ["symbol", "tf"])
    way = F.when(F.col("price") >= F.col("p.price"), "bull").otherwise("bear")
    open_ = open_.select("symbol", "tf", F.col("p.i").alias("from_i"), F.col("p.price").alias("from_price"), F.col("i").alias("to_i"), F.col("price").alias("to_price"), F.lit(None).cast("int").alias("confirmed_i"), way.alias("direction"), F.lit(True).alias("active"))
    return segments(zigzag).withColumn("active", F.lit(False)).unionByName(open_)


def at_resolution(bars: DataFrame, coarse: DataFrame, k: int) -> DataFrame:
    """Pivots of coarse bars (with high_index, low_index and source_end) placed on the finer bars: i is the bar of the
    extreme, confirmed_i the last fine bar of the coarse bar that confirms."""
    found = pivots(coarse, k)
    own = coarse.select("symbol", "i", "high_index", "low_index")
    end = coarse.select("symbol", F.col("i").alias("confirmed_i"), "source_end")
    at = found.join(own, ["symbol", "i"]).join(end, ["symbol", "confirmed_i"])
    placed = at.select("symbol", "kind", F.when(F.col("kind") == "high", F.col("high_index")).otherwise(F.col("low_index")).alias("i"), "price", F.col("source_end").alias("confirmed_i"))
    return placed.join(bars.select("symbol", "tf", "i", "time"), ["symbol", "i"])


INTERNAL_SCHEMA = "kind string, i int, price double, confirmed_i int"


def internal_zigzag(bars: DataFrame, *, length: int = 5, min_leg: int = 3, times: float = 0.5, min_move: float = 0.0) -> DataFrame:
    """Alternating pivots with a least leg and move (in units of the two bars' mean atr); bars need column atr."""

    def kernel(b: dict[str, np.ndarray]) -> dict:
        high, low, open_, close, atr = b["high"], b["low"], b["open"], b["close"], b["atr"].astype(float)
        kept: list[tuple[str, int]] = []
        price = {"high": high, "low": low}
        for c in range(length, len(high) - length):
            left, right = slice(c - length, c), slice(c + 1, c + length + 1)
            is_high = high[c] >= high[left].max() and high[c] > high[right].max()
            is_low = low[c] <= low[left].min() and low[c] < low[right].min()
            order = [k for k, ok in (("high", is_high), ("low", is_low)) if ok]
            if len(order) == 2:
                first_low = kept[-1][0] == "high" if kept else close[c] >= open_[c]
                order = ["low", "high"] if first_low else ["high", "low"]
            for kind in order:
                if not kept:
                    kept.append((kind, c))
                    continue
                was, at = kept[-1]
                if kind == was:
                    if price[kind][c] > price[kind][at] if kind == "high" else price[kind][c] < price[kind][at]:
                        kept[-1] = (kind, c)
                    continue
                known = [a for a in (atr[c], atr[at]) if not np.isnan(a)]
                least = max(times * sum(known) / len(known) if known else 0.0, min_move)
                if c > at and c - at >= min_leg and abs(price[kind][c] - price[was][at]) >= least:
                    kept.append((kind, c))
        return {"kind": [k for k, _ in kept], "i": [c for _, c in kept], "price": [price[k][c] for k, c in kept], "confirmed_i": [c + length for _, c in kept]}

    return fold(bars.select("symbol", "tf", "i", "open", "high", "low", "close", "atr"), kernel, INTERNAL_SCHEMA)


def _later_extreme(side: int):
    """Of two bars (i, p) the one further out (side 1: up), the later on ties."""
    return lambda a, x: F.when(a["p"].isNull() | (x["p"] * side >= a["p"] * side), x).otherwise(a)


def ghost_trace(bars: DataFrame, length: int = 50) -> DataFrame:
    """Where the running extreme against the last anchor appears and moves.

    Anchors are confirmed pivots (the low if a bar is both) and bar 0. After an
    anchor is known, the first bar shows the extreme since the anchor bar
    (appearance, the latest on ties); a later bar beyond all before it is a move.
    """
    found = pivots(bars.withColumn("__z", F.lit(0)).select("symbol", "tf", "i", "time", "high", "low"), length, left_ties=True)
    anchors = found.groupBy("symbol", "tf", F.col("confirmed_i").alias("known")).agg(F.max_by(F.struct(F.col("i").alias("anchor"), "kind"), F.col("kind") == "low").alias("a"))
    at = bars.join(anchors, (bars.symbol == anchors.symbol) & (bars.tf == anchors.tf) & (bars.i == anchors.known), "left").select(bars["*"], "a")
    start = F.last(F.when(F.col("a").isNotNull(), F.struct(F.col("i").alias("known"), F.col("a.anchor").alias("anchor"), F.col("a.kind").alias("kind"))), ignorenulls=True).over(rows_between(Window.unboundedPreceding, 0))
    zero = F.struct(F.lit(0).alias("known"), F.lit(0).alias("anchor"), F.lit("initial").alias("kind"))
    at = at.withColumn("s", F.coalesce(start, zero)).withColumn("ghost_type", F.when(F.col("s.kind") == "high", "low").otherwise("high"))
    # an anchor lies `length` bars before it is known, so the first bar looks back over at most that many bars
    for kind, best in (("high", F.max), ("low", F.min)):
        side = 1 if kind == "high" else -1
        back = F.collect_list(F.struct("i", F.col(kind).alias("p"))).over(rows_between(-(length - 1), 0))
        since = F.filter(back, lambda x: x["i"] > F.col("s.anchor"))
        latest = F.reduce(since, F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("p")), _later_extreme(side))
        at = at.withColumn(f"__first_{kind}", F.when((F.col("i") == F.col("s.known")) & (F.col("s.kind") != "initial"), latest))
        run = F.coalesce(F.when(F.col("i") == F.col("s.known"), F.col(f"__first_{kind}")["p"]), F.when(F.col("i") > F.col("s.anchor"), F.col(kind)))
        at = at.withColumn(f"__run_{kind}", run)
        at = at.withColumn(f"__before_{kind}", best(f"__run_{kind}").over(along("s").rowsBetween(Window.unboundedPreceding, -1)))
    pick = lambda name: F.when(F.col("ghost_type") == "high", F.col(f"__{name}_high")).otherwise(F.col(f"__{name}_low"))
    at = at.withColumn("__first", pick("first")).withColumn("__before", pick("before")).withColumn("__price", F.when(F.col("ghost_type") == "high", F.col("high")).otherwise(F.col("low")))
    first = F.col("__first.i").isNotNull()
    opening = (F.col("s.kind") == "initial") & (F.col("i") == 1)
    beyond = F.when(F.col("ghost_type") == "high", F.col("__price") > F.col("__before")).otherwise(F.col("__price") < F.col("__before"))
    move = (F.col("i") > F.col("s.known")) & ~opening & beyond & ~first
    out = at.where(first | opening | move)
    return out.select(
        "symbol", "tf", F.col("i").alias("event_i"), F.when(first, F.col("__first.i")).otherwise(F.col("i")).alias("ghost_i"), F.when(first, F.col("__first.p")).otherwise(F.col("__price")).alias("ghost_price"),
        "ghost_type", F.when(first | opening, "appearance").otherwise("move").alias("relocation"), F.col("s.anchor").alias("anchor_i"), F.when(F.col("s.kind") == "high", "high").otherwise("low").alias("anchor_type"), F.col("time").alias("event_time"),
    )


MISSED_SCHEMA = "source string, kind string, i int, price double, confirmed_i int, reason string, end_i int, active int"


def missed_pivots(bars: DataFrame, length: int = 50) -> DataFrame:
    """Regular and missed pivots with the reason; a missed one's level lasts until the next (end_i, active)."""

    def kernel(b: dict[str, np.ndarray]) -> list[tuple]:
        high, low, n = b["high"], b["low"], len(b["high"])
        out: list[list] = []
        levels: list[int] = []
        seen: set[tuple] = set()
        last = None
        top = bottom = dip = peak = None  # (price, bar): extremes since the last pivot, and those that followed them

        def missed(kind, extreme, known, reason):
            if extreme is None or extreme[1] >= known or (kind, extreme[1], known) in seen:
                return
            seen.add((kind, extreme[1], known))
            if levels:
                out[levels[-1]][6:8] = [known, 0]
            levels.append(len(out))
            out.append(["missed", kind, extreme[1], extreme[0], known, reason, n - 1, 1])

        for known in range(length, n):
            c = known - length
            h, l = high[c], low[c]
            if top is None or h > top[0]:
                top, dip = (h, c), (l, c)
            if bottom is None or l < bottom[0]:
                bottom, peak = (l, c), (h, c)
            if dip is None or l < dip[0]:
                dip = (l, c)
            if peak is None or h > peak[0]:
                peak = (h, c)
            if c < length:
                continue
            left, right = slice(c - length, c), slice(c + 1, c + length + 1)
            is_high = h >= high[left].max() and h > high[right].max()
            is_low = l <= low[left].min() and l < low[right].min()
            if is_high and is_low:
                out.append(["ambiguous", "both", c, float("nan"), known, "skipped_without_context" if last is None else "low_after_high" if last == "high" else "high_after_low", None, None])
                is_high, is_low = last == "low", last == "high"
            if is_high:
                if last == "high":
                    missed("low", bottom and (bottom[0], bottom[1]), known, "consecutive_confirmed_highs")
                elif top is not None and h < top[0]:
                    first = last is None
                    missed("high", top, known, "initial_higher_extreme_before_first_high" if first else "higher_extreme_before_lower_high")
                    missed("low", dip, known, "initial_opposite_extreme_after_higher_high" if first else "opposite_extreme_after_higher_high")
                out.append(["regular", "high", c, h, known, None, None, None])
                last, top, bottom, dip, peak = "high", (h, c), (h, c), (h, c), (h, c)
            elif is_low:
                if last == "low":
                    missed("high", top, known, "consecutive_confirmed_lows")
                elif last is None:
                    missed("high", top, known, "initial_high_before_first_low")
                elif bottom is not None and l > bottom[0]:
                    missed("low", bottom, known, "lower_extreme_before_higher_low")
                    missed("high", peak, known, "opposite_extreme_after_lower_low")
                out.append(["regular", "low", c, l, known, None, None, None])
                last, top, bottom, dip, peak = "low", (l, c), (l, c), (l, c), (l, c)
        return out

    return fold(bars.select("symbol", "tf", "i", "high", "low"), kernel, MISSED_SCHEMA)


def provisional(bars: DataFrame, missed: DataFrame, cursor: int | None = None) -> DataFrame:
    """The first opposite extreme after the last regular pivot, up to the cursor."""
    regular = missed.where("source = 'regular'")
    if cursor is not None:
        regular, bars = regular.where(F.col("confirmed_i") <= cursor), bars.where(F.col("i") <= cursor)
    last = regular.groupBy("symbol", "tf").agg(F.max_by(F.struct("kind", "i", "price"), "confirmed_i").alias("last"))
    at = bars.join(last, ["symbol", "tf"]).where(F.col("i") > F.col("last.i"))
    low = F.min_by(F.struct("i", F.col("low").alias("price")), F.struct("low", "i"))
    high = F.min_by(F.struct("i", F.col("high").alias("price")), F.struct((-F.col("high")).alias("x"), F.col("i")))
    out = at.groupBy("symbol", "tf", "last").agg(low.alias("low"), high.alias("high"))
    best = F.when(F.col("last.kind") == "high", F.col("low")).otherwise(F.col("high"))
    return out.select("symbol", "tf", F.when(F.col("last.kind") == "high", "low").otherwise("high").alias("kind"), best["i"].alias("i"), best["price"].alias("price"), F.col("last.i").alias("from_i"), F.col("last.price").alias("from_price"))


def deduped(found: DataFrame) -> DataFrame:
    """One pivot for each kind, bar and price; a derived one wins over a provided one (column source)."""
    first = F.row_number().over(along("kind", F.format_string("%.10f", "price"), "i", order="source"))
    return found.withColumn("__first", first).where("__first = 1").drop("__first")
