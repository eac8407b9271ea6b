"""As-of, interval and nearest joins on bar ordinals, without comparing all pairs of a series."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY

BUCKET = 64


def as_of(left: DataFrame, right: DataFrame, at: str, known: str, columns: list[str], prefix: str = "") -> DataFrame:
    """left with `columns` of the last right row of the series with known <= at; ties go to the greatest row.

    One sort of both sides together; a left row sees the last right row before it.
    """
    values = F.struct(*columns).alias("__v")
    a = left.select(*KEY, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(values).schema[0].dataType).alias("__v"))
    b = right.select(*KEY, F.col(known).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), values)
    w = Window.partitionBy(*KEY).orderBy("__at", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__l.*", *[F.col(f"__v.{c}").alias(prefix + c) for c in columns])


def within(points: DataFrame, spans: DataFrame, at: str, first: str, last: str, bucket: int = BUCKET, also: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and spans of a series with first <= at <= last (null last: open); each span meets its buckets only.

    An open span lasts to its series' last point. Columns in `also` must be equal too.
    """
    end = points.groupBy(*KEY).agg(F.max(at).alias("__end"))
    s = spans.join(end, KEY).withColumn("__last", F.least(F.coalesce(last, "__end"), F.col("__end"))).where(F.col(first) <= F.col("__last"))
    s = s.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col("__last") / bucket))))
    p = points.withColumn("__bucket", F.floor(F.col(at) / bucket))
    return p.join(s, [*KEY, "__bucket", *also]).where((F.col(at) >= F.col(first)) & (F.col(at) <= F.col("__last"))).drop("__bucket", "__last", "__end")


def first_beyond(asked: DataFrame, bars: DataFrame, *, after: str, price: str, way: str, to: str, fan: int = 1024) -> DataFrame:
    """asked with `to`: the first bar after `after` whose high is above `price` (way 1) or whose low is below it (way -1), null if none.

    Bars stand in blocks of `fan`, blocks with their extremes in blocks of
    `fan`, and so on. A row looks at what follows in its own block, then at what
    follows that block in the next larger one, and so on up; where one has an
    extreme beyond the price it goes down into it. Each step is a join by block,
    with at most `fan` values looked at: 2 log(bars) steps, whatever the distance.
    """
    each = F.explode(F.array(F.struct(F.lit(1).alias("__way"), F.col("high").alias("v")), F.struct(F.lit(-1).alias("__way"), (-F.col("low")).alias("v"))))
    level = bars.select(*KEY, F.col("i").cast("long").alias("at"), each.alias("x")).select(*KEY, "at", "x.*")
    last = bars.agg(F.max("i")).first()[0] or 0
    depth = 1
    while last >= fan**depth:
        depth += 1
    blocks = []
    for _ in range(depth):
        held = level.groupBy(*KEY, "__way", F.floor(F.col("at") / fan).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("__v"))
        blocks.append(held.withColumn("__v", F.transform("__v", lambda x: x["v"])))
        level = level.groupBy(*KEY, "__way", F.floor(F.col("at") / fan).alias("at")).agg(F.max("v").alias("v"))
    rows = asked.withColumn("__way", F.col(way)).withColumn("__at", F.col(after).cast("long")).withColumn("__price", F.col(price) * F.col(way)).withColumn("__level", F.lit(None).cast("int"))

    def looked(rows: DataFrame, block: Column, beyond: Column, k: int) -> DataFrame:
        """rows with __hit, the first place in their block of level k after the offset `beyond` that lies beyond the price."""
        met = rows.withColumn("__block", block).join(blocks[k], [*KEY, "__way", "__block"], "left")
        flags = F.transform("__v", lambda v, j: (j > beyond) & (v > F.col("__price")))
        place = F.array_position(flags, F.lit(True))
        return met.withColumn("__hit", F.when(place > 0, F.col("__block") * fan + place - 1)).drop("__v", "__block")

    for k in range(depth):
        asks = F.col("__level").isNull()
        rows = looked(rows, F.when(asks, F.floor(F.col("__at") / fan)), F.pmod(F.col("__at"), F.lit(fan)), k)
        found = F.col("__hit").isNotNull()
        rows = rows.withColumn("__at", F.when(asks & found, F.col("__hit")).when(asks, F.floor(F.col("__at") / fan)).otherwise(F.col("__at")))
        rows = rows.withColumn("__level", F.when(asks & found, F.lit(k)).otherwise(F.col("__level"))).drop("__hit")
    for k in range(depth - 2, -1, -1):
        goes = F.col("__level") > k
        rows = looked(rows, F.when(goes, F.col("__at")), F.lit(-1), k)
        rows = rows.withColumn("__at", F.when(goes, F.col("__hit")).otherwise(F.col("__at"))).drop("__hit")
    return rows.withColumn(to, F.when(F.col("__level").isNotNull(), F.col("__at")).cast("int")).drop("__way", "__at", "__price", "__level")


NEAR_SCHEMA = "symbol string, tf int, {point} int, kind string, value double, width double, tie double"


def nearest_open(points: DataFrame, spans: DataFrame, *, point: str, at: str, ref: str, chunk: int = 4096) -> DataFrame:
    """For each point and kind of spans, the span open there whose value is nearest to the point's price: value, width, tie.

    spans: kind, value, tie (the greatest wins among equally near ones), width,
    first and last (the bars at which it is seen; a null last is open). points:
    an integer id, a bar and a price. A series is cut into stretches of `chunk`
    bars; each is swept with the open spans of a kind in the order of their
    values, so a point costs two searches, not all open spans, and stretches run
    in parallel. A span is sent to each stretch that it reaches.
    """
    end = points.groupBy(*KEY).agg(F.max(at).alias("__end"))
    s = spans.join(end, KEY).withColumn("__last", F.least(F.coalesce("last", "__end"), F.col("__end"))).where("first <= __last")
    s = s.select(*[F.col(c).alias(f"__{c}") for c in KEY], F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("__last") / chunk))).alias("__chunk"), F.col("kind"), F.col("value"), F.col("tie"), F.col("width"), F.col("first").cast("long").alias("first"), F.col("__last").cast("long").alias("last"))
    p = points.select(*KEY, F.floor(F.col(at) / chunk).alias("chunk"), F.col(point).cast("int").alias("id"), F.col(at).cast("long").alias("at"), F.col(ref).alias("ref"))

    def sweep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not left.empty and not right.empty:
            key = (left["symbol"].iloc[0], int(left["tf"].iloc[0]))
            left = left.sort_values("at", kind="stable")
            asked = list(zip(left["id"].tolist(), left["at"].tolist(), left["ref"].tolist(), strict=True))
            for kind, own in right.sort_values(["first", "last", "value", "tie"]).groupby("kind", sort=True):
                out += [(*key, i, kind, *found) for i, found in _swept(asked, list(zip(*[own[c].tolist() for c in ("first", "last", "value", "tie", "width")], strict=True)))]
        return pd.DataFrame(out, columns=["symbol", "tf", point, "kind", "value", "width", "tie"])

    return p.groupBy(*KEY, "chunk").cogroup(s.groupBy(*[f"__{c}" for c in KEY], "__chunk")).applyInPandas(sweep, NEAR_SCHEMA.format(point=point))


def _swept(asked: list[tuple], spans: list[tuple]) -> list[tuple]:
    """Points (id, at, ref) by at and spans (first, last, value, tie, width) by first: (id, (value, width, tie)) of the nearest open ones."""
    seen: list[tuple] = []  # open spans by value, tie, width
    ends: list[tuple] = []
    out, nxt = [], 0
    for i, at, ref in asked:
        while nxt < len(spans) and spans[nxt][0] <= at:
            _, last, value, tie, width = spans[nxt]
            bisect.insort(seen, (value, tie, -width))
            heapq.heappush(ends, (last, value, tie, -width))
            nxt += 1
        while ends and ends[0][0] < at:
            gone = heapq.heappop(ends)[1:]
            seen.pop(bisect.bisect_left(seen, gone))
        if not seen or ref != ref:
            continue
        up = bisect.bisect_left(seen, (ref,))
        near = [seen[up - 1]] if up else []
        if up < len(seen):
            near.append(seen[bisect.bisect_right(seen, (seen[up][0], math.inf, math.inf)) - 1])
        value, tie, width = min(near, key=lambda x: (abs(x[0] - ref), -x[1]))
        out.append((i, (value, -width, tie)))
    return out
