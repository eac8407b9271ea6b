"""Mixing sources to target weights along a curriculum that changes over training.

Every source has a weight schedule: knots (time, weight) between which the
weight is linear, time running from 0 (first training token) to 1 (last). The
integral of a schedule is the source's weight in the whole mix. Its running
integral, times the source's target, is the demand for the source's words up
to a time; inverting that demand at a document's cumulative word offset gives
the time at which the document is trained. Documents are then range-sorted by
that position.

Scale: one pass makes (source, bucket) totals, where a bucket is a prefix of
the document's order hash, so that a source with a third of all rows is spread
over about sqrt(rows) buckets. A running sum over bucket totals and one within
each bucket give the exact offset of every document, whatever the number of
buckets. Only sources, not documents, meet in one task.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; repeated rows are mixed as separate rows; an empty table gives
an empty mix; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

Knots = Sequence[tuple[float, float]]

#: Falling, level and rising weight; their integrals are 5, 2 and 1.
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 6.0), (0.5, 5.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)


def integral(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def invert(knots: Knots, share: Column) -> Column:
    """The time at which the running integral of the schedule reaches `share` of its whole."""
    whole, done = integral(knots), 0.0
    out = F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        rest, slope = share * whole - done, (w1 - w0) / (t1 - t0)
        # rest = w0 u + slope u^2 / 2; this form of the root holds for slope 0 too
        root = 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
        pieces.append((done + area, t0 + root))
        done += area
    for top, at in reversed(pieces):
        out = F.when(share * whole <= top, at).otherwise(out)
    return F.least(F.greatest(out, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def order_hash(doc_id: Column, size: Column) -> Column:
    """60 bits that fix the order of a source's documents; md5, so that any SQL engine can repeat it. The size spreads rows of one id, null ids too."""
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, schedules: Sequence[Knots], share: float, cap: float) -> DataFrame:
    """totals (source, source_size) with class, weight and target.

    The fair level is found once for all sources: with sources in order of
    cap * size / weight, those before the first one whose fair share fits
    under its cap are capped, and the rest share what is left by weight. One
    row a source, so the one-task window holds only sources.
    """
    k = len(schedules)
    weight = F.element_at(F.array(*[F.lit(float(integral(s))) for s in schedules]), (F.col("class") + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    named = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("class", F.col("rank") % k).withColumn("weight", weight)
    named = named.withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fits = named.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    fair = F.min(F.when(F.col("fits"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return fits.withColumn("target", F.least(F.col("limit"), F.coalesce(fair * F.col("weight"), F.col("limit")))).select("source", "source_size", "class", "weight", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str | None = "text", source_col: str = "source", size: Column | None = None, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with size, source_size, target, copies, taken and positions (one per copy, in training time).

    A document is taken whole, `copies` times; copy p of a source starts where
    copy p-1 of the whole source ends, and a copy is taken while its middle
    lies below the target, so a source misses its target by at most half a
    document. Columns of these names in docs are replaced.
    """
    new = ("size", "source_size", "target", "copies", "taken", "positions")
    base = docs.withColumn("__size", size if size is not None else word_count(F.col(text_col))).drop(*new)
    base = base.withColumn("__h", order_hash(F.col(id_col), F.col("__size"))).withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")))
    rows = base.select("__h").count()
    bits = max(0, math.ceil(math.log2(max(rows, 1)) / 2))
    base = base.withColumn("__b", F.shiftright("__h", 60 - bits))

    cells = base.groupBy("__s", "__b").agg(F.sum("__size").alias("__cell"))
    totals = cells.groupBy("__s").agg(F.sum("__cell").alias("source_size")).withColumn("source", F.when(F.col("__s") != "", F.substring("__s", 2, 1 << 30)))
    targets = source_targets(totals.select("source", "source_size"), schedules, share, cap)
    targets = targets.withColumn("__s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    along = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__cell").over(along), F.lit(0))).drop("__cell").join(targets, "__s")

    inside = Window.partitionBy("__s", "__b").orderBy("__h", id_col, "__size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(cells, ["__s", "__b"])
    middle = lambda p: F.col("__before") + F.col("__in") + p * F.col("source_size") + F.col("__size") / 2
    copies = sum(((middle(p) < F.col("target")).cast("int") for p in range(math.ceil(cap))), F.lit(0))
    at = F.lit(None).cast("double")
    position = []
    for p in range(math.ceil(cap)):
        reached = at
        for c, knots in enumerate(schedules):
            reached = F.when(F.col("class") == c, invert(knots, F.try_divide(middle(p), F.col("target")))).otherwise(reached)
        position.append(reached)
    return (
        placed.withColumn("copies", copies)
        .withColumn("positions", F.slice(F.array(*position), F.lit(1), F.greatest(F.col("copies"), F.lit(0))))
        .withColumn("taken", F.col("__size") * F.col("copies"))
        .withColumnRenamed("__size", "size")
        .drop("__h", "__s", "__b", "__before", "__in", "class", "weight")
    )


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each copy taken, with its position, range-sorted by it."""
    return mixed.withColumn("position", F.explode("positions")).drop("positions").orderBy("position", id_col)


def _inverse_sql(knots: Knots, share: str) -> str:
    """SQL of invert()."""
    whole, done, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        rest, slope = f"({share} * {whole}::DOUBLE - {done}::DOUBLE)", (w1 - w0) / (t1 - t0)
        done += (t1 - t0) * (w0 + w1) / 2
        out.append(f"WHEN {share} * {whole}::DOUBLE <= {done}::DOUBLE THEN {t0}::DOUBLE + 2 * {rest} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {rest}, 0)))")
    return f"least(greatest(CASE {' '.join(out)} ELSE 1 END, 0), 1)"


def _position_sql(copy: int) -> str:
    share = f"((mid + {copy} * source_size) / nullif(target, 0))"
    return f"round(CASE WHEN mid + {copy} * source_size < target THEN CASE rank % 3 {' '.join(f'WHEN {c} THEN {_inverse_sql(k, share)}' for c, k in enumerate(SCHEDULES))} END END, 6)"


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
l AS (
  SELECT *, lim / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, rank, source_size, least(lim, coalesce((SELECT level FROM l f WHERE f.level <= f.ratio ORDER BY f.ratio, f.rank LIMIT 1) * weight, lim)) AS target FROM l),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size + d.size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * ((mid < target)::INT + (mid + source_size < target)::INT))::BIGINT AS taken,
       {_position_sql(0)} AS position_1, {_position_sql(1)} AS position_2
FROM m
"""
