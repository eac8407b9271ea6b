"""Pivots, zigzags, missed pivots and the ghost trace on literal fixtures and against loops."""

import random

from barwright.operators import pivots as P

from .helpers import bars, rows


def test_hldv(spark):
    prices = [10, 5, 12, 6, 11, 4]
    zigzag = spark.createDataFrame([("X", 1, "high" if k % 2 == 0 else "low", k, float(p), k) for k, p in enumerate(prices)], "symbol string, tf int, kind string, i int, price double, confirmed_i int")
    assert [r[1] for r in rows(P.labelled(zigzag), "i", "label")] == ["LH", "LL", "HH", "HL", "LH", "LL"]


def test_ties(spark):
    at = bars(spark, [(5, 1), (7, 2), (5, 3), (7, 2), (5, 1), (4, 2)])
    assert rows(P.pivots(at, 1), "i", "kind") == [(1, "high"), (3, "high"), (4, "low")]
    at = bars(spark, [(5, 1), (7, 2), (7, 3), (5, 2)])
    assert rows(P.pivots(at, 1), "i", "kind") == []
    assert rows(P.pivots(at, 1, left_ties=True), "i", "kind") == [(2, "high")]


def test_ghost_trace_vector(spark):
    at = bars(spark, [(10, 5), (11, 6), (15, 7), (12, 8), (11, 7), (13, 7), (14, 6)])
    got = rows(P.ghost_trace(at, 1), "event_i", "ghost_i", "ghost_type", "relocation", "ghost_price")
    assert got == [(1, 1, "high", "appearance", 11), (2, 2, "high", "move", 15), (3, 3, "low", "appearance", 8), (4, 4, "low", "move", 7), (6, 6, "low", "move", 6)]


def trace_loop(high, low, length):
    """The trace by a plain loop."""
    n, out, anchor, side, ghost = len(high), [], 0, "initial", None

    def pivot(c, x, sign):
        return length <= c and all(sign * x[c] >= sign * x[j] if j < c else sign * x[c] > sign * x[j] for j in range(c - length, c + length + 1) if j != c)

    for i in range(n):
        c = i - length
        new = False
        if c >= length and pivot(c, high, 1):
            anchor, side, new = c, "high", True
        if c >= length and pivot(c, low, -1):
            anchor, side, new = c, "low", True
        x, sign = (low, -1) if side == "high" else (high, 1)
        if new or ghost is None:
            if anchor + 1 > i:
                continue
            best = max(range(anchor + 1, i + 1), key=lambda j: (sign * x[j], j))
            ghost = x[best]
            out.append((i, best, "appearance"))
        elif sign * x[i] > sign * ghost:
            ghost = x[i]
            out.append((i, i, "move"))
    return out


def test_ghost_trace_equals_loop(spark):
    rng = random.Random(4)
    for length in (1, 2, 3):
        high = [rng.randint(5, 12) for _ in range(90)]
        low = [h - rng.randint(1, 5) for h in high]
        got = rows(P.ghost_trace(bars(spark, list(zip(high, low, strict=True))), length), "event_i", "ghost_i", "relocation")
        assert got == trace_loop(high, low, length)


def test_missed_pivot_of_the_start(spark):
    got = rows(P.missed_pivots(bars(spark, [(10, 6), (8, 4), (9, 5)]), 1).where("source = 'missed'"), "kind", "i", "confirmed_i")
    assert got == [("high", 0, 2)]


def test_one_active_level(spark):
    rng = random.Random(9)
    at = bars(spark, [(h := rng.uniform(10, 20), h - rng.uniform(1, 4)) for _ in range(120)])
    got = P.missed_pivots(at, 2)
    assert got.where("active = 1").count() == 1
    early = rows(P.missed_pivots(at.where("i <= 80"), 2).where("source <> 'ambiguous'"), "source", "kind", "i", "price", "confirmed_i")
    assert early == rows(got.where("confirmed_i <= 80 and source <> 'ambiguous'"), "source", "kind", "i", "price", "confirmed_i")


def test_zigzags_alternate_and_hold_for_prefixes(spark):
    rng = random.Random(2)
    at = bars(spark, [(h := rng.uniform(10, 20), h - rng.uniform(1, 4)) for _ in range(150)], atr=1.0)
    kinds = [r[1] for r in rows(P.compress(P.pivots(at, 2)), "i", "kind")]
    assert len(kinds) > 20 and all(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    inner = [r[1] for r in rows(P.internal_zigzag(at, length=2, min_leg=2), "i", "kind")]
    assert len(inner) > 5 and all(a != b for a, b in zip(inner, inner[1:], strict=False))
    assert rows(P.compress(P.pivots(at, 2), 80), "i", "price") == rows(P.compress(P.pivots(at.where("i <= 80"), 2)), "i", "price")
