"""Queries by name over bars of the events table, and the DuckDB SQL that gives the same rows.

Bars are hourly, one series for each event type, unless a query says otherwise.
Doubles are rounded to six places on both sides, as sums may be made in any
order; where exact ties at the seventh place occur, 3e-8 is added on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import extract as E
from ..operators import features as X
from ..operators import learning as M
from ..operators import levels as Z
from ..operators import liquidity as L
from ..operators import pivots as P
from ..operators import profile as A
from ..operators import regime as G
from ..operators import series as V
from ..operators import strategy as T
from ..operators import structure as S
from ..operators import views as W
from ..operators.scratch import kept
from ..sources.candles import candles_from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY = ["symbol", "tf"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_(sql)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- SQL building blocks: each is named once and pulls in what it names -----------------------------------------

PARTS = {
    "ev": "SELECT event_type AS symbol, floor(epoch(ts))::BIGINT AS es, value + 100 AS px, ts, event_id FROM events",
    "bars": """SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time) - 1)::INT AS i, 60 AS tf FROM (
        SELECT symbol, es // 3600 * 3600 AS time, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
               arg_max(px, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM ev GROUP BY ALL)""",
    "minutes": """SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time) - 1)::INT AS i, 1 AS tf FROM (
        SELECT symbol, es // 60 * 60 AS time, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
               arg_max(px, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM ev GROUP BY ALL)""",
    "tr": """SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr
        FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY i) AS pc FROM bars)""",
    "atr": """SELECT symbol, 13 AS i, sum(tr) / 14 AS atr FROM tr WHERE i <= 13 GROUP BY symbol HAVING count(*) = 14
        UNION ALL SELECT a.symbol, t.i, (a.atr * 13 + t.tr) / 14 FROM atr a JOIN tr t ON t.symbol = a.symbol AND t.i = a.i + 1""",
    "atr_late": """SELECT symbol, 14 AS i, sum(tr) / 14 AS atr FROM tr WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
        UNION ALL SELECT a.symbol, t.i, (a.atr * 13 + t.tr) / 14 FROM atr_late a JOIN tr t ON t.symbol = a.symbol AND t.i = a.i + 1""",
    "atr10": """SELECT symbol, 10 AS i, sum(tr) / 10 AS atr FROM tr WHERE i BETWEEN 1 AND 10 GROUP BY symbol HAVING count(*) = 10
        UNION ALL SELECT a.symbol, t.i, (a.atr * 9 + t.tr) / 10 FROM atr10 a JOIN tr t ON t.symbol = a.symbol AND t.i = a.i + 1""",
    "ext": "SELECT * FROM pv9",
    "levels": """SELECT p.symbol, p.kind, p.i, p.price, p.confirmed_i, CASE WHEN e.i IS NULL THEN 'internal' ELSE 'external' END AS scope,
               coalesce(e.confirmed_i, p.confirmed_i) AS scope_confirmed_i, CASE p.kind WHEN 'high' THEN 'BSL' ELSE 'SSL' END AS type,
               CASE p.kind WHEN 'high' THEN 'sh' ELSE 'sl' END AS side
        FROM pv3 p LEFT JOIN pv9 e USING (symbol, kind, i)""",
    "sweeps": """SELECT l.symbol, l.kind, l.i, min(b.i) AS swept_i FROM levels l JOIN bars b ON b.symbol = l.symbol AND b.i > l.confirmed_i
               AND CASE l.kind WHEN 'high' THEN b.high > l.price ELSE b.low < l.price END GROUP BY ALL""",
    "ends": """SELECT l.*, s.swept_i, r.resolved_i, r.classification FROM levels l LEFT JOIN sweeps s USING (symbol, kind, i)
        LEFT JOIN (
          SELECT symbol, kind, i, CASE WHEN o0 AND o1 AND o2 THEN swept_i + 2 WHEN NOT o0 THEN swept_i WHEN NOT o1 THEN swept_i + 1 WHEN NOT o2 THEN swept_i + 2 END AS resolved_i,
                 CASE WHEN o0 AND o1 AND o2 THEN 'RUN' WHEN NOT o0 THEN 'SWEEP' WHEN NOT o1 OR NOT o2 THEN CASE scope WHEN 'external' THEN 'BIG_GRAB' ELSE 'GRAB' END END AS classification
          FROM (SELECT l.symbol, l.kind, l.i, l.scope, s.swept_i,
                       bool_or(b.i = s.swept_i AND CASE l.kind WHEN 'high' THEN b.close > l.price ELSE b.close < l.price END) AS o0,
                       CASE WHEN bool_or(b.i = s.swept_i + 1) THEN bool_or(b.i = s.swept_i + 1 AND CASE l.kind WHEN 'high' THEN b.close > l.price ELSE b.close < l.price END) END AS o1,
                       CASE WHEN bool_or(b.i = s.swept_i + 2) THEN bool_or(b.i = s.swept_i + 2 AND CASE l.kind WHEN 'high' THEN b.close > l.price ELSE b.close < l.price END) END AS o2
                FROM levels l JOIN sweeps s USING (symbol, kind, i) JOIN bars b ON b.symbol = l.symbol AND b.i BETWEEN s.swept_i AND s.swept_i + 2 GROUP BY ALL)
          WHERE NOT o0 OR NOT o1 OR o2 IS NOT NULL) r USING (symbol, kind, i)""",
    "fvg": """SELECT symbol, tf, i, i + 1 AS confirmed_i, CASE WHEN up THEN 'bull' ELSE 'bear' END AS direction,
               CASE WHEN up THEN rl ELSE ll END AS top, CASE WHEN up THEN lh ELSE rh END AS bottom
        FROM (SELECT *, rl > lh AND close > lh AND d > th AS up, rh < ll AND close < ll AND -d > th AS down FROM (
          SELECT *, coalesce(2 * avg(abs(d)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS th FROM (
            SELECT *, lag(high) OVER w AS lh, lag(low) OVER w AS ll, lead(high) OVER w AS rh, lead(low) OVER w AS rl,
                   CASE WHEN open <> 0 AND lag(low) OVER w IS NOT NULL AND lead(low) OVER w IS NOT NULL THEN (close - open) / abs(open) END AS d
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)))
          WHERE d IS NOT NULL)
        WHERE up OR down""",
    "features": """SELECT *, coalesce(stddev_samp(return_1) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING), 0) AS volatility FROM (
        SELECT b.symbol, b.tf, b.i, b.time, coalesce(close / lag(close) OVER w - 1, 0) AS return_1, coalesce(close / lag(close, 20) OVER w - 1, 0) AS trend_return,
               coalesce(abs(atr / close), abs(high - low) / abs(close)) AS atr_pct, volume / avg(volume) OVER (PARTITION BY b.symbol ORDER BY b.i ROWS 19 PRECEDING) AS volume_ratio, b.i >= 20 AS available
        FROM bars b LEFT JOIN atr USING (symbol, i) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.i))""",
}


def pivot_sql(k: int, ties: bool = False) -> str:
    eq = "=" if ties else ""
    return f"""SELECT symbol, tf, kind, i, time, price, i + {k} AS confirmed_i FROM (
        SELECT *, unnest([{{'kind': 'high', 'price': high, 'ok': high >{eq} lh AND high > rh}}, {{'kind': 'low', 'price': low, 'ok': low <{eq} ll AND low < rl}}], recursive := true) FROM (
          SELECT *, count(*) OVER (PARTITION BY symbol) AS n, max(high) OVER l AS lh, min(low) OVER l AS ll, max(high) OVER r AS rh, min(low) OVER r AS rl FROM bars
          WINDOW l AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)))
        WHERE ok AND i >= {k} AND i + {k} < n"""


def zigzag_sql(source: str) -> str:
    """Pivots in order, each a state that holds the last kept pivot and the price before it; a kept pivot ends with the next seq."""
    return f"""SELECT symbol, 1 AS r, 1 AS seq, kind, i, price, confirmed_i, NULL::DOUBLE AS before FROM ({source}) WHERE r = 1
        UNION ALL
        SELECT symbol, r, seq + (step = 'add')::INT, CASE step WHEN 'stay' THEN kind ELSE nk END, CASE step WHEN 'stay' THEN i ELSE ni END, CASE step WHEN 'stay' THEN price ELSE np END,
               CASE step WHEN 'stay' THEN confirmed_i ELSE nc END, CASE step WHEN 'add' THEN price ELSE before END
        FROM (SELECT p.symbol, p.r, z.seq, z.kind, z.i, z.price, z.confirmed_i, z.before, p.kind AS nk, p.i AS ni, p.price AS np, p.confirmed_i AS nc,
                CASE WHEN p.kind = z.kind THEN CASE WHEN CASE p.kind WHEN 'high' THEN p.price >= z.price ELSE p.price <= z.price END THEN 'turn' ELSE 'stay' END
                     WHEN p.i = z.i THEN CASE WHEN abs(p.price - z.before) > abs(z.price - z.before) THEN 'turn' ELSE 'stay' END ELSE 'add' END AS step
              FROM SELF z JOIN ({source}) p ON p.symbol = z.symbol AND p.r = z.r + 1)"""


DAYS = "(SELECT *, min(i) OVER (PARTITION BY symbol, time // 86400) AS segment FROM bars)"
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, kind, price) AS r FROM pv9"
SHALLOW = NUMBERED.replace("pv9", "pv3")
PARTS |= {
    "zz_all": zigzag_sql(NUMBERED).replace("SELF", "zz_all"),
    "zz_cut": zigzag_sql(NUMBERED + " WHERE confirmed_i <= 150").replace("SELF", "zz_cut"),
    "zz": "SELECT symbol, 60 AS tf, seq, arg_max(kind, r) AS kind, arg_max(i, r) AS i, arg_max(price, r) AS price, arg_max(confirmed_i, r) AS confirmed_i FROM zz_all GROUP BY symbol, seq",
    "zz150": "SELECT symbol, 60 AS tf, seq, arg_max(kind, r) AS kind, arg_max(i, r) AS i, arg_max(price, r) AS price, arg_max(confirmed_i, r) AS confirmed_i FROM zz_cut GROUP BY symbol, seq",
    "zz_fine": zigzag_sql(SHALLOW).replace("SELF", "zz_fine"),
    "piv": "SELECT 'internal' AS scope, * FROM pv3 UNION ALL SELECT 'external', * FROM pv9",
    "fresh": """SELECT scope, symbol, confirmed_i, max(price) FILTER (kind = 'high') AS hp, max(i) FILTER (kind = 'high') AS hi, max(price) FILTER (kind = 'low') AS lp, max(i) FILTER (kind = 'low') AS li
        FROM piv GROUP BY ALL""",
    "steps": """SELECT s.scope, b.symbol, b.i, b.close, lag(b.close) OVER (PARTITION BY s.scope, b.symbol ORDER BY b.i) AS pc, f.hp, f.hi, f.lp, f.li
        FROM bars b CROSS JOIN (VALUES ('internal'), ('external')) s(scope) LEFT JOIN fresh f ON f.scope = s.scope AND f.symbol = b.symbol AND f.confirmed_i = b.i""",
    "brk": """SELECT scope, symbol, i, 0 AS trend, 0 AS was, NULL::DOUBLE AS hp, NULL::INT AS hi, NULL::DOUBLE AS lp, NULL::INT AS li, NULL::VARCHAR AS way, NULL::DOUBLE AS level, NULL::INT AS pivot_i FROM steps WHERE i = 0
        UNION ALL
        SELECT scope, symbol, i, CASE way WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 ELSE trend END, trend, CASE WHEN way = 'bull' THEN NULL ELSE hp END, CASE WHEN way = 'bull' THEN NULL ELSE hi END,
               CASE WHEN way = 'bear' THEN NULL ELSE lp END, CASE WHEN way = 'bear' THEN NULL ELSE li END, way, CASE way WHEN 'bull' THEN hp WHEN 'bear' THEN lp END, CASE way WHEN 'bull' THEN hi WHEN 'bear' THEN li END
        FROM (SELECT *, CASE WHEN pc <= hp AND hp < close THEN 'bull' WHEN pc >= lp AND lp > close THEN 'bear' END AS way FROM (
          SELECT s.scope, s.symbol, s.i, k.trend, s.pc, s.close, coalesce(s.hp, k.hp) AS hp, coalesce(s.hi, k.hi) AS hi, coalesce(s.lp, k.lp) AS lp, coalesce(s.li, k.li) AS li
          FROM brk k JOIN steps s ON s.scope = k.scope AND s.symbol = k.symbol AND s.i = k.i + 1))""",
    "broken": """SELECT symbol, 60 AS tf, CASE WHEN was = CASE way WHEN 'bull' THEN -1 ELSE 1 END THEN 'CHOCH' ELSE 'BOS' END AS type, scope, way AS direction, i, level, pivot_i,
               pivot_i + CASE scope WHEN 'internal' THEN 3 ELSE 9 END AS pivot_confirmed_i, was AS previous_trend FROM brk WHERE way IS NOT NULL""",
    "signals": """SELECT e.symbol, e.side, e.classification, e.resolved_i, least(CASE classification WHEN 'SWEEP' THEN 0.90 WHEN 'GRAB' THEN 0.82 WHEN 'BIG_GRAB' THEN 0.88 ELSE 0.85 END + CASE WHEN b.volume > 0 THEN 0.05 ELSE 0 END, 0.95)::DOUBLE AS w
        FROM ends e JOIN bars b ON b.symbol = e.symbol AND b.i = coalesce(e.swept_i, e.i) WHERE resolved_i IS NOT NULL""",
    "raised": """SELECT e.*, m.s IS NOT NULL AS boosted, coalesce(m.s.w, 0.5) AS probability_weight, m.s.c AS liquidity_signal FROM broken e LEFT JOIN (
          SELECT e.symbol, e.direction, e.i, max({'w': g.w, 'c': g.classification}) AS s FROM broken e JOIN signals g ON g.symbol = e.symbol AND e.i BETWEEN g.resolved_i AND g.resolved_i + 10
            AND g.side = CASE WHEN (e.type = 'CHOCH') = (e.direction = 'bull') THEN 'sl' ELSE 'sh' END AND (g.classification = 'RUN') <> (e.type = 'CHOCH')
          WHERE e.scope = 'internal' GROUP BY ALL) m ON e.scope = 'internal' AND m.symbol = e.symbol AND m.direction = e.direction AND m.i = e.i""",
    "super_": """SELECT b.symbol, b.i, b.close, (high + low) / 2 AS up, (high + low) / 2 AS down, 1 AS d FROM bars b WHERE i = 0
        UNION ALL
        SELECT symbol, i, close, CASE WHEN bu < up OR pc > up THEN bu ELSE up END, CASE WHEN bl > down OR pc < down THEN bl ELSE down END, CASE WHEN d = -1 AND close > up THEN 1 WHEN d = 1 AND close < down THEN -1 ELSE d END
        FROM (SELECT b.symbol, b.i, b.close, s.close AS pc, s.up, s.down, s.d, (b.high + b.low) / 2 + 3 * coalesce(a.atr, 0) AS bu, (b.high + b.low) / 2 - 3 * coalesce(a.atr, 0) AS bl
              FROM super_ s JOIN bars b ON b.symbol = s.symbol AND b.i = s.i + 1 LEFT JOIN atr10 a ON a.symbol = b.symbol AND a.i = b.i)""",
    "pairs_": """SELECT symbol, i, close, max(high) OVER w AS hm, min(low) OVER w AS lm, avg(high) OVER w AS ha, avg(low) OVER w AS la, coalesce(lag(high) OVER o, high) AS ph, coalesce(lag(low) OVER o, low) AS pl
        FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY i), w AS (PARTITION BY symbol ORDER BY i ROWS 1 PRECEDING)""",
    "half_": """SELECT symbol, -1 AS i, 0 AS now, 0 AS waiting, low AS top, high AS floor_, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS flipped FROM bars WHERE i = 0
        UNION ALL
        SELECT symbol, i, n2, w2, t2, f2, CASE WHEN n2 = 0 THEN CASE WHEN turned THEN down ELSE greatest(t2, up) END ELSE up END,
               CASE WHEN n2 = 1 THEN CASE WHEN turned THEN up WHEN down = 0 THEN f2 ELSE least(f2, down) END ELSE down END, turned::INT
        FROM (SELECT *, i > 0 AND n2 <> now AS turned FROM (
          SELECT *, CASE WHEN sell THEN 1 WHEN buy THEN 0 ELSE now END AS n2, CASE WHEN sell THEN 0 WHEN buy THEN 1 ELSE waiting END AS w2, CASE WHEN buy THEN lm ELSE t1 END AS t2, CASE WHEN sell THEN hm ELSE f1 END AS f2 FROM (
            SELECT *, waiting = 1 AND ha < t1 AND close < pl AS sell, waiting = 0 AND la > f1 AND close > ph AS buy FROM (
              SELECT p.*, h.now, h.waiting, h.up, h.down, CASE h.waiting WHEN 1 THEN greatest(h.top, p.lm) ELSE h.top END AS t1, CASE h.waiting WHEN 0 THEN least(h.floor_, p.hm) ELSE h.floor_ END AS f1
              FROM half_ h JOIN pairs_ p ON p.symbol = h.symbol AND p.i = h.i + 1))))""",
    "ways": """SELECT h.symbol, h.i, CASE h.now WHEN 0 THEN 1 ELSE -1 END AS main, s.d AS other, b.time FROM half_ h JOIN super_ s USING (symbol, i) JOIN bars b USING (symbol, i)""",
    "turns": "SELECT * FROM (SELECT *, lag(main) OVER (PARTITION BY symbol ORDER BY i) AS before FROM ways) WHERE before <> main",
    "found_": """SELECT t.symbol, t.i AS trigger_i, t.main, min(w.i) AS i FROM (SELECT *, lead(i) OVER (PARTITION BY symbol ORDER BY i) AS next FROM turns) t
        JOIN ways w ON w.symbol = t.symbol AND w.i BETWEEN t.i AND t.i + 5 AND (t.next IS NULL OR w.i < t.next) AND w.other = t.main GROUP BY ALL""",
    "marks_": """SELECT symbol, min(i) AS i FROM bars GROUP BY symbol, time // 86400
        UNION SELECT symbol, coalesce(min(i) FILTER (time % 86400 >= 34200), min(i)) FROM bars GROUP BY symbol, time // 86400 HAVING count(*) FILTER (time % 86400 >= 34200) > 0 OR time // 86400 < (SELECT max(x.time // 86400) FROM bars x WHERE x.symbol = bars.symbol)
        UNION SELECT symbol, i FROM broken""",
    "near_": """SELECT b.symbol, b.i, bool_or(NOT o) AS inner_, bool_or(o) AS outer_
        FROM (SELECT b.*, atr FROM bars b JOIN atr USING (symbol, i) WHERE atr > 0) b JOIN ends e ON e.symbol = b.symbol AND e.confirmed_i <= b.i AND (e.resolved_i IS NULL OR e.resolved_i > b.i), LATERAL (SELECT e.scope = 'external' AND e.scope_confirmed_i <= b.i AS o)
        WHERE abs(b.close - e.price) <= atr * CASE WHEN o THEN 0.75 ELSE 0.5 END GROUP BY b.symbol, b.i""",
    "seen_": """SELECT b.symbol, b.i, b.time, CASE WHEN a.atr > 0 THEN CASE WHEN n.outer_ THEN 'LIQUIDEZ_EXTERNA' WHEN n.inner_ THEN 'LIQUIDEZ_INTERNA' WHEN f.i <= b.i THEN 'ZONA_INTERNA' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS base,
               CASE WHEN a.atr > 0 THEN CASE WHEN n.outer_ THEN 0.60 WHEN n.inner_ THEN 0.52 WHEN f.i <= b.i THEN 0.45 ELSE 0.35 END ELSE 0.30 END + CASE WHEN v.m > 0 AND b.volume >= v.m * 1.35 THEN 0.05 ELSE 0 END AS score,
               coalesce(l.raid_out, false) AS raid_out, coalesce(l.raid_in, false) AS raid_in, coalesce(l.run_out, false) AS run_out, l.symbol IS NULL AND k.symbol IS NULL AS quiet, coalesce(k.bos, 0) AS bos, coalesce(k.choch, false) AS choch
        FROM bars b LEFT JOIN atr a USING (symbol, i) LEFT JOIN near_ n USING (symbol, i) LEFT JOIN (SELECT symbol, min(confirmed_i) AS i FROM ends GROUP BY symbol) f ON f.symbol = b.symbol
        LEFT JOIN (SELECT symbol, i, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS m FROM bars) v USING (symbol, i)
        LEFT JOIN (SELECT symbol, resolved_i AS i, bool_or(classification <> 'RUN' AND o) AS raid_out, bool_or(classification <> 'RUN' AND NOT o) AS raid_in, bool_or(classification = 'RUN' AND o) AS run_out
                   FROM (SELECT *, scope = 'external' AND scope_confirmed_i <= resolved_i AS o FROM ends WHERE resolved_i IS NOT NULL) GROUP BY ALL) l USING (symbol, i)
        LEFT JOIN (SELECT symbol, i, max(CASE WHEN scope = 'external' AND type = 'BOS' THEN CASE direction WHEN 'bull' THEN 2 ELSE 1 END END) AS bos, bool_or(scope = 'external' AND type = 'CHOCH') AS choch FROM broken GROUP BY ALL) k USING (symbol, i)""",
    "regime_": """SELECT symbol, -1 AS i, 0::BIGINT AS time, 'UNKNOWN' AS state, 0.0::DOUBLE AS confidence FROM seen_ WHERE i = 0
        UNION ALL
        SELECT symbol, i, time, s, round(least(greatest(score + CASE w WHEN 1 THEN 0.30 WHEN 2 THEN CASE WHEN run_out THEN 0.35 ELSE 0.25 END WHEN 3 THEN 0.20 WHEN 4 THEN 0.10 WHEN 5 THEN -0.05 WHEN 6 THEN 0.05 ELSE 0 END, 0), 1), 2)::DOUBLE
        FROM (SELECT n.*, CASE WHEN n.raid_out AND n.choch THEN 1 WHEN n.bos > 0 THEN 2 WHEN n.choch THEN 3 WHEN n.raid_in THEN 4 WHEN r.state = 'TRANSITION' AND n.base IN ('ZONA_INTERNA', 'LIQUIDEZ_INTERNA') THEN 5
                       WHEN r.state IN ('TR_BULLISH', 'TR_BEARISH') AND n.quiet THEN 6 ELSE 0 END AS w,
                CASE w WHEN 1 THEN 'TRANSITION' WHEN 2 THEN CASE n.bos WHEN 2 THEN 'TR_BULLISH' ELSE 'TR_BEARISH' END WHEN 3 THEN 'TRANSITION' WHEN 4 THEN 'ZM_MANIPULATION' WHEN 5 THEN 'ZM_MANIPULATION' WHEN 6 THEN r.state ELSE n.base END AS s
              FROM regime_ r JOIN seen_ n ON n.symbol = r.symbol AND n.i = r.i + 1)""",
    "fed_": """SELECT b.symbol, b.i, b.open, b.high, b.low, b.close, e.n, f.main AS side, a.atr AS sa FROM bars b JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) e ON e.symbol = b.symbol
        LEFT JOIN found_ f ON f.symbol = b.symbol AND f.i = b.i - 1 LEFT JOIN atr a ON a.symbol = b.symbol AND a.i = b.i - 1""",
    "book_": """SELECT symbol, -1 AS i, 10000.0::DOUBLE AS equity, NULL::INT AS way, NULL::INT AS sig, NULL::INT AS ei, NULL::DOUBLE AS entry, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::DOUBLE AS units, NULL::DOUBLE AS paid,
               false AS traded, NULL::INT AS tway, NULL::INT AS tsig, NULL::INT AS tei, NULL::DOUBLE AS tentry, NULL::DOUBLE AS price, NULL::VARCHAR AS reason, NULL::DOUBLE AS net, NULL::VARCHAR AS skipped, NULL::INT AS side, 10000.0::DOUBLE AS marked
        FROM fed_ WHERE i = 0
        UNION ALL
        SELECT symbol, i, CASE WHEN gone THEN eq + gross - cost ELSE eq END, CASE WHEN NOT gone THEN cw END, CASE WHEN NOT gone THEN cs END, CASE WHEN NOT gone THEN ci END, CASE WHEN NOT gone THEN ce END, CASE WHEN NOT gone THEN cstop END, CASE WHEN NOT gone THEN ct END,
               CASE WHEN NOT gone THEN cu END, CASE WHEN NOT gone THEN cp END, gone, cw, cs, ci, ce, price, why, gross - cp - cost, skipped, side, CASE WHEN gone THEN eq + gross - cost ELSE eq + coalesce(cw * (close - ce) * cu, 0) END
        FROM (SELECT *, cw IS NOT NULL AND (stopped OR reached OR i = n) AS gone, CASE WHEN stopped THEN 'stop' WHEN reached THEN 'target' ELSE 'end_of_data' END AS why, raw * (1 - cw * 0.0001) AS price, cw * (price - ce) * cu AS gross, abs(price * cu) * 0.0002 AS cost FROM (
          SELECT *, CASE WHEN stopped THEN CASE WHEN cw * open < cw * cstop THEN open ELSE cstop END WHEN reached THEN CASE WHEN cw * open > cw * ct THEN open ELSE ct END ELSE close END AS raw FROM (
            SELECT *, CASE WHEN cw > 0 THEN low <= cstop ELSE high >= cstop END AS stopped, CASE WHEN cw > 0 THEN high >= ct ELSE low <= ct END AS reached FROM (
              SELECT symbol, i, open, high, low, close, n, side, CASE WHEN way IS NOT NULL THEN way WHEN ok THEN side END AS cw, CASE WHEN way IS NOT NULL THEN sig WHEN ok THEN i - 1 END AS cs, CASE WHEN way IS NOT NULL THEN ei WHEN ok THEN i END AS ci,
                     CASE WHEN way IS NOT NULL THEN entry WHEN ok THEN e2 END AS ce, CASE WHEN way IS NOT NULL THEN stop WHEN ok THEN s2 END AS cstop, CASE WHEN way IS NOT NULL THEN target WHEN ok THEN t2 END AS ct, CASE WHEN way IS NOT NULL THEN units WHEN ok THEN u2 END AS cu,
                     CASE WHEN way IS NOT NULL THEN paid WHEN ok THEN abs(e2 * u2) * 0.0002 END AS cp, CASE WHEN way IS NULL AND ok THEN equity - abs(e2 * u2) * 0.0002 ELSE equity END AS eq,
                     CASE WHEN side IS NOT NULL AND way IS NOT NULL THEN 'position_open_at_entry' WHEN side IS NOT NULL AND NOT ok THEN 'missing_or_invalid_risk_levels' END AS skipped
              FROM (SELECT *, least(equity * 0.01 / abs(e2 - s2), equity / e2) AS u2, coalesce(sa > 0 AND side * s2 < side * e2 AND side * e2 < side * t2, false) AS ok FROM (
                SELECT *, e2 - side * sa * 1.5 AS s2, e2 + (e2 - s2) * 2 AS t2 FROM (
                  SELECT f.*, f.open * (1 + f.side * 0.0001) AS e2, k.equity, k.way, k.sig, k.ei, k.entry, k.stop, k.target, k.units, k.paid FROM book_ k JOIN fed_ f ON f.symbol = k.symbol AND f.i = k.i + 1)))))))""",
    "bins_": """SELECT symbol, segment, bin, lo, hi, step, round(coalesce(sum(part), 0), 9) AS v FROM (
          SELECT e.symbol, e.segment, g.bin, e.lo, e.hi, (e.hi - e.lo) / 24 AS step,
                 CASE WHEN d.high > d.low THEN d.volume * greatest(least(e.lo + (g.bin + 1) * ((e.hi - e.lo) / 24), d.high) - greatest(e.lo + g.bin * ((e.hi - e.lo) / 24), d.low), 0) / (d.high - d.low)
                      ELSE d.volume END AS part
          FROM (SELECT symbol, segment, CASE WHEN h > l THEN l ELSE l - greatest(abs(l) * 1e-9, 1e-9) / 2 END AS lo, CASE WHEN h > l THEN h ELSE h + greatest(abs(l) * 1e-9, 1e-9) / 2 END AS hi
                FROM (SELECT symbol, segment, min(low) AS l, max(high) AS h FROM DAYS_ GROUP BY ALL)) e CROSS JOIN range(24) g(bin)
          LEFT JOIN DAYS_ d ON d.symbol = e.symbol AND d.segment = e.segment AND d.volume > 0
            AND g.bin BETWEEN least(greatest(floor((d.low - e.lo) / ((e.hi - e.lo) / 24)), 0), 23) AND least(greatest(floor((CASE WHEN d.high > d.low THEN d.high ELSE d.low END - e.lo) / ((e.hi - e.lo) / 24)), 0), 23))
        GROUP BY symbol, segment, bin, lo, hi, step""",
    "area_": """SELECT symbol, segment, lo, step, list(v ORDER BY bin) AS v, arg_min(bin, (-v, bin)) AS poc, arg_min(bin, (-v, bin)) AS a, arg_min(bin, (-v, bin)) AS b, max(v) AS held, total, 0 AS k
        FROM bins_ JOIN (SELECT symbol, segment, sum(volume) AS total FROM DAYS_ WHERE volume > 0 GROUP BY ALL) USING (symbol, segment) GROUP BY symbol, segment, lo, step, total
        UNION ALL
        SELECT symbol, segment, lo, step, v, poc, CASE WHEN up >= down THEN a ELSE a - 1 END, CASE WHEN up >= down THEN b + 1 ELSE b END, held + greatest(up, down), total, k + 1
        FROM (SELECT *, CASE WHEN b < 23 THEN v[b + 2] ELSE -1 END AS up, CASE WHEN a > 0 THEN v[a] ELSE -1 END AS down FROM area_) WHERE round(held, 9) < round(total * 0.7, 9) AND greatest(up, down) >= 0""",
    "value_": """SELECT symbol, segment, lo, step, poc, total, arg_max(a, k) AS a, arg_max(b, k) AS b FROM area_ GROUP BY ALL""",
    "obs": """SELECT e.symbol, e.tf, e.type, e.scope, e.direction, e.i AS triggered_by, e.boosted, e.probability_weight, arg_min(b.i, (CASE e.direction WHEN 'bull' THEN b.low ELSE -b.high END, b.i)) AS i,
               arg_min(b.high, (CASE e.direction WHEN 'bull' THEN b.low ELSE -b.high END, b.i)) AS top, arg_min(b.low, (CASE e.direction WHEN 'bull' THEN b.low ELSE -b.high END, b.i)) AS bottom, e.i AS confirmed_i
        FROM raised e JOIN bars b ON b.symbol = e.symbol AND b.i BETWEEN e.pivot_i AND e.i WHERE e.pivot_i > 0
        GROUP BY e.symbol, e.tf, e.type, e.scope, e.direction, e.i, e.boosted, e.probability_weight, e.pivot_i""",
}
PARTS = {k: v.replace("DAYS_", DAYS) for k, v in PARTS.items()}
PARTS |= {"pv3": pivot_sql(3), "pv9": pivot_sql(9), "tied": pivot_sql(5, True)}


def with_(body: str) -> str:
    """The body with the parts that it names, in order of need."""
    import re

    body = body.replace("DAYS_", DAYS)

    named: list[str] = []

    def need(text: str) -> None:
        for part in PARTS:
            if part not in named and re.search(rf"\b{part}\b", text):
                rest = PARTS[part].replace(f" {part} ", " ") if f"FROM {part} " in PARTS[part] else PARTS[part]
                need(re.sub(rf"\b{part}\b", "", rest))
                named.append(part)

    need(body)
    return "WITH RECURSIVE " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in named) + "\n" + body


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_events(spark, sf_dir, 60, offset=100)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_from_events(spark, sf_dir, 1, offset=100)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.indicators(hourly(spark, sf_dir))


def external(bars: DataFrame) -> DataFrame:
    return P.pivots(bars, 9)


def breaks(bars: DataFrame) -> DataFrame:
    return S.breaks(bars, P.pivots(bars, 3), "internal").unionByName(S.breaks(bars, external(bars), "external"))


def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars for a query with several branches: written, so that the ticks are read once."""
    return kept(hourly(spark, sf_dir), "hourly")


def scored(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    bars = once(spark, sf_dir) if bars is None else bars
    return L.with_volume_score(L.levels(bars), bars, B.volume_index(minutes(spark, sf_dir), 60))


def lifted(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Breaks with the liquidity events that raise their weight."""
    bars = once(spark, sf_dir) if bars is None else bars
    return S.boosted(kept(breaks(bars), "breaks"), scored(spark, sf_dir, bars))


# ---- bars ---------------------------------------------------------------------------------------------------------


@query("SELECT symbol, tf, i, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def r1_ohlcv_1h(spark, sf_dir):
    return B.resample(minutes(spark, sf_dir), 60).select("symbol", "tf", "i", "time", "open", "high", "low", "close", "volume")


@query("""SELECT symbol, tf, (row_number() OVER (PARTITION BY symbol, tf ORDER BY time) - 1)::INT AS i, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM (
  SELECT symbol, tf, es // (tf * 60) * tf * 60 AS time, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM ev, unnest([5, 15, 60, 120, 240, 1440, 10080]) AS x(tf) GROUP BY ALL)""")
def r2_multi_tf(spark, sf_dir):
    return B.resample_many(minutes(spark, sf_dir))


@query("""SELECT symbol, 60 AS tf, time // 3600 * 3600 - 0 AS time, sum(volume) AS volume, min(i) AS source_start, max(i) AS source_end, time // 3600 * 3600 + 3600 AS end_time
FROM (SELECT symbol, i, volume, (time + 19800) // 3600 * 3600 - 19800 AS time0, (time + 19800) // 3600 * 3600 - 19800 AS t, time FROM minutes) GROUP BY ALL""".replace("time // 3600 * 3600 - 0 AS time", "t AS time").replace("time // 3600 * 3600 + 3600", "t + 3600"))
def r3_local_offset(spark, sf_dir):
    bars = minutes(spark, sf_dir).withColumn("tz_offset", F.lit(19800))
    return B.resample_local(bars, 60).select("symbol", "tf", "time", "volume", "source_start", "source_end", "end_time")


@query("""SELECT symbol, 60 AS tf, time // 3600 * 3600 AS time, arg_min(i, (-high, i)) AS high_index, arg_min(i, (low, i)) AS low_index, min(i) AS source_start, max(i) AS source_end
FROM minutes GROUP BY symbol, time // 3600 * 3600""")
def r4_extreme_pos(spark, sf_dir):
    return B.resample_extremes(minutes(spark, sf_dir), 60).select("symbol", "tf", "time", "high_index", "low_index", "source_start", "source_end")


@query("""SELECT symbol, time // (m * 60) * m * 60 // 3600 * 3600 AS time, sum(volume) FILTER (m = 1) AS v1m, sum(volume) FILTER (m = 5) AS v5m, sum(volume) FILTER (m = 15) AS v15m
FROM minutes, unnest([1, 5, 15]) AS x(m) GROUP BY 1, 2""")
def r5_volume_index(spark, sf_dir):
    return B.volume_index(minutes(spark, sf_dir), 60)


@query("SELECT symbol, tf, i, time, volume FROM bars WHERE i BETWEEN 10 AND 40")
def r7_slice(spark, sf_dir):
    return B.rows(hourly(spark, sf_dir), 10, 40).select("symbol", "tf", "i", "time", "volume")


@query("SELECT symbol, tf, count(*) AS size, max(i) AS i, max(time) AS time, round(arg_max(close, i), 6) AS close FROM bars WHERE i <= 99 GROUP BY symbol, tf")
def r8_prefix_last(spark, sf_dir):
    return B.last_bar(hourly(spark, sf_dir), 99).select("symbol", "tf", "size", "i", "time", "close")


@query("""SELECT symbol, tf, i, time, new_day, new_hour FROM (
  SELECT *, coalesce(time // 86400 <> lag(time // 86400) OVER w, true) AS new_day, coalesce(time // 3600 <> lag(time // 3600) OVER w, true) AS new_hour
  FROM minutes WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE new_day OR new_hour""")
def r9_time_anchors(spark, sf_dir):
    return B.time_anchors(minutes(spark, sf_dir))


@query("""SELECT symbol, tf, round(min(low) - greatest((max(high) - min(low)) * 0.06, 0.5), 6) AS y_min, round(max(high) + greatest((max(high) - min(low)) * 0.06, 0.5), 6) AS y_max, round(max(volume) * 1.15, 6) AS volume_max
FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM bars) WHERE i > n - 85 GROUP BY symbol, tf""")
def r12_viewport_range(spark, sf_dir):
    return B.y_range(B.viewport(hourly(spark, sf_dir), 100))


# ---- series -------------------------------------------------------------------------------------------------------


@query("SELECT symbol, tf, i, round(tr, 6) AS tr FROM tr")
def v1_true_range(spark, sf_dir):
    return V.true_range(hourly(spark, sf_dir)).select(*KEY, "i", "tr")


@query("SELECT b.symbol, b.tf, b.i, round(atr, 6) AS atr FROM bars b LEFT JOIN atr USING (symbol, i)")
def v2_atr14(spark, sf_dir):
    return V.average_true_range(hourly(spark, sf_dir)).select(*KEY, "i", "atr")


@query("SELECT b.symbol, b.tf, b.i, round(atr, 6) AS atr_late FROM bars b LEFT JOIN atr_late USING (symbol, i)")
def v3_atr_liquidity(spark, sf_dir):
    return V.average_true_range(hourly(spark, sf_dir), late=True, to="atr_late").select(*KEY, "i", "atr_late")


@query("SELECT b.symbol, b.tf, b.i, round(coalesce(a.atr, (SELECT x.atr FROM atr10 x WHERE x.symbol = b.symbol AND x.i = 10)), 6) AS atr_zero FROM bars b LEFT JOIN atr10 a USING (symbol, i)")
def v4_atr_backfill(spark, sf_dir):
    return V.indicators(hourly(spark, sf_dir), warmup="backfill").select(*KEY, "i", "atr_zero")


@query(""", ema AS (SELECT symbol, i, volume AS e FROM bars WHERE i = 0 UNION ALL SELECT b.symbol, b.i, b.volume * 0.2 + e.e * (1 - 0.2) FROM ema e JOIN bars b ON b.symbol = e.symbol AND b.i = e.i + 1)
SELECT symbol, 60 AS tf, i, round(e, 6) AS ema_volume FROM ema""")
def v6_ema9_volume(spark, sf_dir):
    return V.exponential_average(hourly(spark, sf_dir), "volume", 9, "ema_volume").select(*KEY, "i", "ema_volume")


@query("""SELECT symbol, tf, i, round(m, 6) AS volume_average, m > 0 AND volume >= m * 1.35 AS high_volume FROM (
  SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS m FROM bars)""")
def v7_volume_avg(spark, sf_dir):
    return V.volume_average(hourly(spark, sf_dir)).select(*KEY, "i", "volume_average", "high_volume")


def features(spark, sf_dir):
    return V.regime_features(measured(spark, sf_dir), F.col("atr"))


@query("SELECT symbol, tf, i, round(return_1, 6) AS return_1, round(trend_return, 6) AS trend_return, round(volatility, 6) AS volatility, round(atr_pct, 6) AS atr_pct, round(volume_ratio, 6) AS volume_ratio, available FROM features")
def v8_regime_features(spark, sf_dir):
    return features(spark, sf_dir).select(*KEY, "i", *M.FEATURES, "available")


@query("""SELECT b.symbol, b.tf, n, round(s, 6) AS slope, round(max(greatest(high - s * i - c, 0)), 6) AS upper, round(max(greatest(s * i + c - low, 0)), 6) AS lower
FROM bars b JOIN (SELECT symbol, regr_slope(close, i) AS s, regr_intercept(close, i) AS c, count(*) AS n FROM bars GROUP BY symbol) USING (symbol) GROUP BY b.symbol, b.tf, n, s, c""")
def v9_regression_channel(spark, sf_dir):
    return V.regression_channel(hourly(spark, sf_dir)).select(*KEY, "n", "slope", "upper", "lower")


@query("""SELECT p.symbol, p.tf, n, round(s, 6) AS slope, round(sqrt(sum((price - s * i - c) ** 2) / n), 6) AS sigma
FROM pv9 p JOIN (SELECT symbol, regr_slope(price, i) AS s, regr_intercept(price, i) AS c, count(*) AS n FROM pv9 GROUP BY symbol HAVING count(*) >= 2) USING (symbol) GROUP BY p.symbol, p.tf, n, s, c""")
def v10_pivot_regression(spark, sf_dir):
    return V.pivot_regression(external(hourly(spark, sf_dir))).select(*KEY, "n", "slope", "sigma")


# ---- pivots -------------------------------------------------------------------------------------------------------


@query("SELECT symbol, tf, kind, i, time, round(price, 6) AS price, confirmed_i FROM pv3")
def p1_pivots_k3(spark, sf_dir):
    return P.pivots(hourly(spark, sf_dir), 3)


@query("SELECT symbol, 60 AS tf, kind, i, scope, scope_confirmed_i FROM levels")
def p2_external_scope(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return P.scoped(P.pivots(bars, 3), external(bars)).select(*KEY, "kind", "i", "scope", "scope_confirmed_i")


@query("SELECT symbol, tf, kind, i, round(price, 6) AS price, confirmed_i FROM tied")
def p10_internal_pivots(spark, sf_dir):
    return P.pivots(hourly(spark, sf_dir), 5, left_ties=True).drop("time")


@query("""SELECT symbol, 60 AS tf, arg_max(kind, r) AS kind, arg_max(i, r) AS i, round(arg_max(price, r), 6) AS price, arg_max(confirmed_i, r) AS confirmed_i FROM zz_fine GROUP BY symbol, seq""")
def p5_zigzag(spark, sf_dir):
    return P.compress(P.pivots(hourly(spark, sf_dir), 3))


@query("""SELECT symbol, tf, kind, i, CASE kind WHEN 'high' THEN CASE WHEN price > b THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > b THEN 'HL' ELSE 'LL' END END AS label
FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY i) AS b FROM pv9)""")
def p6_hldv(spark, sf_dir):
    return P.labelled(external(hourly(spark, sf_dir))).select(*KEY, "kind", "i", "label")


@query("""SELECT symbol, tf, from_i, round(from_price, 6) AS from_price, i AS to_i, round(price, 6) AS to_price, confirmed_i, CASE WHEN price >= from_price THEN 'bull' ELSE 'bear' END AS direction FROM (
  SELECT *, lag(i) OVER w AS from_i, lag(price) OVER w AS from_price FROM zz WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE from_i IS NOT NULL AND from_i <> i""")
def p8_segments(spark, sf_dir):
    return P.segments(P.compress(external(hourly(spark, sf_dir))))


@query("""SELECT b.symbol, 60 AS tf, CASE z.kind WHEN 'high' THEN 'low' ELSE 'high' END AS kind, CASE z.kind WHEN 'high' THEN arg_max(b.i, (-b.low, b.i)) ELSE arg_max(b.i, (b.high, b.i)) END AS i,
       round(CASE z.kind WHEN 'high' THEN min(b.low) ELSE max(b.high) END, 6) AS price, 150 AS confirmed_i
FROM bars b JOIN (SELECT symbol, arg_max(kind, i) AS kind, max(i) AS i FROM zz150 GROUP BY symbol) z ON z.symbol = b.symbol WHERE b.i > z.i AND b.i <= 150 GROUP BY b.symbol, z.kind""")
def p7_developing(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return P.developing(P.compress(external(bars), 150), bars, 150)


@query()
def p12_internal_zigzag(spark, sf_dir):
    return P.internal_zigzag(measured(spark, sf_dir))


@query()
def p15_missed_pivots(spark, sf_dir):
    return P.missed_pivots(hourly(spark, sf_dir), 5)


GHOST = """SELECT symbol, 60 AS tf, event_i, CASE WHEN opens THEN last[2] ELSE bar END AS ghost_i, round(abs(CASE WHEN opens THEN last[1] ELSE own END), 6) AS ghost_price, ghost_type, relocation, anchor_i, anchor_type, event_time FROM (
  SELECT b.symbol, b.i AS event_i, b.time AS event_time, s.anchor AS anchor_i, CASE WHEN s.kind = 'high' THEN 'high' ELSE 'low' END AS anchor_type,
         CASE WHEN s.kind = 'high' THEN 'low' ELSE 'high' END AS ghost_type, b.i = greatest(s.known, 1) AS opens,
         CASE WHEN b.i = greatest(s.known, 1) THEN 'appearance' ELSE 'move' END AS relocation,
         CASE WHEN s.kind = 'high' THEN -b.low ELSE b.high END AS own,
         (SELECT max(CASE WHEN s.kind = 'high' THEN -x.low ELSE x.high END) FROM bars x WHERE x.symbol = b.symbol AND x.i > s.anchor AND x.i < b.i) AS best,
         (SELECT max((CASE WHEN s.kind = 'high' THEN -x.low ELSE x.high END, x.i)) FROM bars x WHERE x.symbol = b.symbol AND x.i > s.anchor AND x.i <= b.i) AS last,
         b.i AS bar
  FROM bars b ASOF JOIN (
    SELECT symbol, known, arg_max(anchor, kind = 'low') AS anchor, arg_max(kind, kind = 'low') AS kind FROM (
      SELECT symbol, confirmed_i AS known, i AS anchor, kind FROM tied) GROUP BY symbol, known
    UNION ALL SELECT DISTINCT symbol, 0, 0, 'initial' FROM bars) s ON s.symbol = b.symbol AND b.i >= s.known WHERE b.i >= 1)
WHERE opens OR own > best"""


@query(GHOST)
def p17_ghost_trace(spark, sf_dir):
    return P.ghost_trace(hourly(spark, sf_dir), 5)


# ---- liquidity ----------------------------------------------------------------------------------------------------


@query("""SELECT symbol, 60 AS tf, side, i, p_i AS eq_pair, round((p_price + price) / 2, 6) AS eq_price, greatest(p_c, confirmed_i) AS eq_confirmed_i FROM (
  SELECT n.*, p.i AS p_i, p.price AS p_price, p.confirmed_i AS p_c, row_number() OVER (PARTITION BY n.symbol, n.side, n.i ORDER BY p.i DESC) AS r
  FROM (SELECT l.*, a.atr FROM levels l JOIN atr_late a USING (symbol, i)) n JOIN (SELECT l.*, a.atr FROM levels l LEFT JOIN atr_late a USING (symbol, i)) p
    ON p.symbol = n.symbol AND p.side = n.side AND p.i < n.i AND n.i - p.i <= 100
  WHERE abs(p.price - n.price) <= 0.05 * coalesce((p.atr + n.atr) / 2, n.atr)
    AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = n.symbol AND b.i > p.confirmed_i AND b.i < n.i
      AND CASE n.side WHEN 'sh' THEN b.high > p.price + 0.05 * coalesce((p.atr + n.atr) / 2, n.atr) ELSE b.low < p.price - 0.05 * coalesce((p.atr + n.atr) / 2, n.atr) END)) WHERE r = 1""")
def l2_equal_levels(spark, sf_dir):
    bars = measured(spark, sf_dir)
    return L.equal_levels(L.base_levels(bars), bars).select(*KEY, "side", "i", "eq_pair", "eq_price", "eq_confirmed_i")


@query("SELECT symbol, 60 AS tf, side, l.i, swept_i FROM levels l JOIN sweeps USING (symbol, kind, i)")
def l3_sweeps(spark, sf_dir):
    return L.levels(once(spark, sf_dir)).where("swept_i is not null").select(*KEY, "side", "i", "swept_i")


@query("SELECT symbol, type, scope, coalesce(classification, CASE WHEN swept_i IS NULL THEN 'DETECTED' ELSE 'SWEPT' END) AS outcome, count(*) AS n FROM ends GROUP BY ALL")
def l4_liquidity_class(spark, sf_dir):
    outcome = F.coalesce("classification", F.when(F.col("swept_i").isNull(), "DETECTED").otherwise("SWEPT"))
    return L.levels(once(spark, sf_dir)).groupBy("symbol", "type", "scope", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT symbol, 60 AS tf, i, side, scope, swept_i, resolved_i, classification FROM ends")
def l1_levels(spark, sf_dir):
    return L.levels(once(spark, sf_dir)).select(*KEY, "i", "side", "scope", "swept_i", "resolved_i", "classification")


VOLUME = "(SELECT e.*, 3 * b.volume AS volume_score FROM ends e JOIN bars b ON b.symbol = e.symbol AND b.i = coalesce(e.swept_i, e.i))"


@query(f"SELECT symbol, 60 AS tf, i, side, volume_score FROM {VOLUME}")
def l5_volume_score(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "i", "side", "volume_score")


@query(f"""SELECT symbol, 60 AS tf, v.i, v.side, volume_score FROM {VOLUME} v JOIN (
  SELECT symbol, s[floor((len(s) - 1) * 0.7 + 0.5)::INT + 1] AS least FROM (SELECT symbol, list_sort(list(volume_score)) AS s FROM {VOLUME} GROUP BY symbol)) USING (symbol) WHERE volume_score >= least""")
def l7_weighted(spark, sf_dir):
    return L.weighted(scored(spark, sf_dir)).select(*KEY, "i", "side", "volume_score")


@query("SELECT symbol, 60 AS tf, i, side, CASE WHEN swept_i <= 120 THEN swept_i END AS swept_i, CASE WHEN resolved_i <= 120 THEN classification END AS classification, CASE WHEN scope_confirmed_i > 120 THEN 'internal' ELSE scope END AS scope FROM ends WHERE confirmed_i <= 120")
def l8_levels_as_of(spark, sf_dir):
    return L.as_of(L.levels(once(spark, sf_dir)), 120).select(*KEY, "i", "side", "swept_i", "classification", "scope")


# ---- structure ----------------------------------------------------------------------------------------------------


@query("""SELECT symbol, tf, type, scope, direction, i, round(level, 6) AS level, pivot_i, pivot_confirmed_i, previous_trend FROM broken""")
def m1_bos_choch(spark, sf_dir):
    return breaks(hourly(spark, sf_dir))


@query("""SELECT symbol, tf, scope, direction, i, boosted, round(probability_weight, 6) AS probability_weight, liquidity_signal FROM raised""")
def m2_boosted_breaks(spark, sf_dir):
    return lifted(spark, sf_dir).select(*KEY, "scope", "direction", "i", "boosted", "probability_weight", "liquidity_signal")


@query("SELECT symbol, tf, i, confirmed_i, direction, round(top, 6) AS top, round(bottom, 6) AS bottom FROM fvg")
def m3_fvg(spark, sf_dir):
    return S.gaps(hourly(spark, sf_dir))


@query("""SELECT f.symbol, f.tf, f.i, f.direction, EXISTS (SELECT 1 FROM ends e WHERE e.symbol = f.symbol AND e.resolved_i BETWEEN f.confirmed_i - 1 AND f.confirmed_i AND e.classification <> 'RUN') AS high_reaction FROM fvg f""")
def m4_fvg_reaction(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.with_reaction(S.gaps(bars), L.levels(bars)).select(*KEY, "i", "direction", "high_reaction")


@query("""SELECT symbol, tf, i, direction, end_i, round(coalesce(max(least(greatest(d, 0), 1)), 0), 6) AS fill_ratio, CASE WHEN end_i IS NULL THEN 'active' ELSE 'mitigated' END AS status FROM (
  SELECT f.*, b.i AS j, CASE direction WHEN 'bull' THEN CASE WHEN b.low <= bottom THEN 1 ELSE (top - b.low) / (top - bottom) END ELSE CASE WHEN b.high >= top THEN 1 ELSE (b.high - bottom) / (top - bottom) END END AS d,
         min(CASE WHEN CASE direction WHEN 'bull' THEN b.low <= bottom ELSE b.high >= top END THEN b.i END) OVER (PARTITION BY f.symbol, f.i) AS end_i
  FROM fvg f LEFT JOIN bars b ON b.symbol = f.symbol AND b.i > f.confirmed_i) WHERE end_i IS NULL OR j <= end_i GROUP BY symbol, tf, i, direction, end_i""")
def m5_fvg_lifecycle(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.lifecycle(bars, S.gaps(bars)).select(*KEY, "i", "direction", "end_i", "fill_ratio", "status")


@query("""SELECT symbol, tf, type, scope, direction, triggered_by, boosted, round(probability_weight, 6) AS probability_weight, i, round(top, 6) AS top, round(bottom, 6) AS bottom, confirmed_i FROM obs""")
def m6_order_blocks(spark, sf_dir):
    bars = once(spark, sf_dir)
    return S.order_blocks(bars, lifted(spark, sf_dir, bars))


@query("""SELECT symbol, tf, type, scope, direction, triggered_by, boosted, round(probability_weight, 6) AS probability_weight, i, round(top, 6) AS top, round(bottom, 6) AS bottom, confirmed_i,
       round(ar, 6) AS average_range, round(rr, 6) AS zone_range_ratio, round(ds, 6) AS displacement, round(vr, 6) AS volume_ratio,
       round(least(ds, 4) * 0.70 + least(rr, 1.5) * 0.45 + least(vr, 3) * 0.20 + CASE scope WHEN 'external' THEN 1.25 ELSE 0 END + CASE WHEN boosted THEN 0.5 ELSE 0 END + probability_weight * 0.30, 6) AS relevance_score,
       CASE scope WHEN 'external' THEN rr >= 0.20 AND ds >= 1.0 ELSE rr >= 0.25 AND ds >= 1.5 END AS relevant
FROM (SELECT *, abs(top - bottom) / ar AS rr, abs(tc - (top + bottom) / 2) / ar AS ds, coalesce(CASE WHEN mv > 0 THEN tv / mv END, 1) AS vr FROM (
  SELECT o.*, greatest(coalesce(CASE WHEN m.mr > 0 THEN m.mr END, abs(o.top - o.bottom)), 1e-12) AS ar, m.mv, t.close AS tc, t.volume AS tv FROM obs o
  JOIN (SELECT symbol, i, avg(CASE WHEN high > low THEN high - low END) OVER w AS mr, avg(CASE WHEN high > low THEN volume END) OVER w AS mv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 20 PRECEDING)) m ON m.symbol = o.symbol AND m.i = o.i
  JOIN bars t ON t.symbol = o.symbol AND t.i = o.triggered_by))""")
def m7_ob_relevance(spark, sf_dir):
    bars = once(spark, sf_dir)
    return S.relevance(S.order_blocks(bars, lifted(spark, sf_dir, bars)), bars)


@query("""SELECT symbol, tf, type, scope, direction, triggered_by, boosted, round(probability_weight, 6) AS probability_weight, i, round(top, 6) AS top, round(bottom, 6) AS bottom, confirmed_i, min(j) FILTER (d > 0) AS first_touch_i, end_i, round(coalesce(max(least(greatest(d, 0), 1)), 0), 6) AS fill_ratio, CASE WHEN end_i IS NULL THEN 'active' ELSE 'mitigated' END AS status FROM (
  SELECT f.*, b.i AS j, CASE f.direction WHEN 'bull' THEN CASE WHEN b.low <= f.bottom THEN 1 ELSE (f.top - b.low) / (f.top - f.bottom) END ELSE CASE WHEN b.high >= f.top THEN 1 ELSE (b.high - f.bottom) / (f.top - f.bottom) END END AS d,
         min(CASE WHEN CASE f.direction WHEN 'bull' THEN b.low <= f.bottom ELSE b.high >= f.top END THEN b.i END) OVER (PARTITION BY f.n) AS end_i
  FROM (SELECT *, row_number() OVER () AS n FROM obs) f LEFT JOIN bars b ON b.symbol = f.symbol AND b.i > f.confirmed_i AND f.top > f.bottom) WHERE end_i IS NULL OR j <= end_i GROUP BY ALL""")
def m8_ob_lifecycle(spark, sf_dir):
    bars = once(spark, sf_dir)
    return S.lifecycle(bars, S.order_blocks(bars, lifted(spark, sf_dir, bars))).drop("fills")


@query("""SELECT l.symbol, 60 AS tf, l.direction, l.from_i, l.to_i, round(l.slope, 6) AS slope, l.confirmed_i, min(b.i) AS break_i FROM (
  SELECT *, CASE kind WHEN 'high' THEN 'bear' ELSE 'bull' END AS direction, (price - p0) / (i - i0) AS slope, i0 AS from_i, i AS to_i FROM (
    SELECT *, lag(i) OVER w AS i0, lag(price) OVER w AS p0 FROM pv3 WINDOW w AS (PARTITION BY symbol, kind ORDER BY i)) WHERE CASE kind WHEN 'high' THEN price < p0 ELSE price > p0 END) l
LEFT JOIN bars b ON b.symbol = l.symbol AND b.i > l.confirmed_i AND CASE l.kind WHEN 'high' THEN b.close > l.price + l.slope * (b.i - l.to_i) ELSE b.close < l.price + l.slope * (b.i - l.to_i) END
GROUP BY l.symbol, l.direction, l.from_i, l.to_i, l.slope, l.confirmed_i""")
def m9_trendlines(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.trendlines(P.pivots(bars, 3), bars).select(*KEY, "direction", "from_i", "to_i", "slope", "confirmed_i", "break_i")


@query("""SELECT symbol, 60 AS tf, round(CASE WHEN t.p >= h.p THEN t.p ELSE h.p END, 6) AS top, CASE WHEN t.p >= h.p THEN t.i ELSE h.i END AS top_i, round(CASE WHEN b.p <= l.p THEN b.p ELSE l.p END, 6) AS bottom,
       CASE WHEN b.p <= l.p THEN -b.i ELSE l.i END AS bottom_i, bias, CASE bias WHEN 'bearish' THEN 'strong_high' ELSE 'weak_high' END AS high_class, CASE bias WHEN 'bullish' THEN 'strong_low' ELSE 'weak_low' END AS low_class
FROM (SELECT k.symbol, k.h, k.l, coalesce(d.bias, 'neutral') AS bias, max({'p': x.high, 'i': x.i}) FILTER (x.i > k.h.c) AS t, min({'p': x.low, 'i': -x.i}) FILTER (x.i > k.l.c) AS b
  FROM (SELECT p.symbol, arg_max({'i': p.i, 'p': p.price, 'c': p.confirmed_i}, p.i) FILTER (kind = 'high') AS h, arg_max({'i': p.i, 'p': p.price, 'c': p.confirmed_i}, p.i) FILTER (kind = 'low') AS l
        FROM pv9 p JOIN (SELECT symbol, max(i) AS c FROM bars GROUP BY symbol) e ON e.symbol = p.symbol WHERE p.confirmed_i < e.c GROUP BY p.symbol) k
  JOIN bars x ON x.symbol = k.symbol
  LEFT JOIN (SELECT n.symbol, CASE arg_max(n.direction, n.i) WHEN 'bull' THEN 'bullish' ELSE 'bearish' END AS bias FROM broken n JOIN (SELECT symbol, max(i) AS c FROM bars GROUP BY symbol) e ON e.symbol = n.symbol WHERE n.scope = 'external' AND n.i < e.c GROUP BY n.symbol) d ON d.symbol = k.symbol
  WHERE k.h IS NOT NULL AND k.l IS NOT NULL GROUP BY k.symbol, k.h, k.l, d.bias)""")
def m10_trailing(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.trailing(bars, external(bars), breaks(bars))


@query("""SELECT symbol, tf, round(h, 6) AS major_high, round(l, 6) AS major_low, round((h + l) / 2, 6) AS equilibrium FROM (
  SELECT symbol, tf, arg_max(price, i) FILTER (kind = 'high') AS h, arg_max(price, i) FILTER (kind = 'low') AS l FROM pv9 WHERE confirmed_i <= 150 GROUP BY symbol, tf)""")
def m12_major_levels(spark, sf_dir):
    return S.major_levels(external(hourly(spark, sf_dir)), 150)


@query("""SELECT symbol, tf, i, confirmed_i, direction, round(CASE direction WHEN 'bull' THEN top - (top - bottom) * f ELSE top END, 6) AS top, round(CASE direction WHEN 'bear' THEN bottom + (top - bottom) * f ELSE bottom END, 6) AS bottom,
       first_touch_i, end_i, round(f, 6) AS fill_ratio, CASE WHEN end_i IS NULL THEN 'active' ELSE 'mitigated' END AS status, place FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confirmed_i DESC, i DESC, direction) AS place FROM (
    SELECT symbol, tf, i, confirmed_i, direction, top, bottom, end_i, min(j) FILTER (d > 0) AS first_touch_i, coalesce(max(least(greatest(d, 0), 1)) FILTER (j <= 228), 0) AS f FROM (
      SELECT f.*, b.i AS j, CASE direction WHEN 'bull' THEN CASE WHEN b.low <= bottom THEN 1 ELSE (top - b.low) / (top - bottom) END ELSE CASE WHEN b.high >= top THEN 1 ELSE (b.high - bottom) / (top - bottom) END END AS d,
             min(CASE WHEN CASE direction WHEN 'bull' THEN b.low <= bottom ELSE b.high >= top END THEN b.i END) OVER (PARTITION BY f.symbol, f.i) AS end_i
      FROM fvg f LEFT JOIN bars b ON b.symbol = f.symbol AND b.i > f.confirmed_i) WHERE end_i IS NULL OR j <= end_i GROUP BY symbol, tf, i, confirmed_i, direction, top, bottom, end_i)
  WHERE confirmed_i <= 228 AND (end_i IS NULL OR end_i > 228)) WHERE place <= 5""")
def m13_active_zones(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.active_zones(S.lifecycle(bars, S.gaps(bars)), 228, 5).drop("fills")


@query("""SELECT f.symbol, f.tf, f.i, f.direction, EXISTS (SELECT 1 FROM ends e WHERE e.symbol = f.symbol AND e.resolved_i BETWEEN f.confirmed_i AND f.confirmed_i + 12 AND e.classification <> 'RUN'
  AND e.side = CASE f.direction WHEN 'bull' THEN 'sl' ELSE 'sh' END) AS reacted FROM fvg f""")
def m14_matched_reaction(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return S.with_matched_reaction(S.gaps(bars), L.levels(bars)).select(*KEY, "i", "direction", "reacted")


# ---- regime, strategy, backtest -----------------------------------------------------------------------------------


@query("""SELECT b.symbol, 60 AS tf, b.i, arg_min(e.i, (abs(b.close - e.price), e.i, e.side)) FILTER (NOT o) AS internal_i, arg_min(e.i, (abs(b.close - e.price), e.i, e.side)) FILTER (o) AS external_i
FROM (SELECT b.*, atr FROM bars b JOIN atr USING (symbol, i) WHERE atr > 0) b JOIN (SELECT * FROM ends) e ON e.symbol = b.symbol AND e.confirmed_i <= b.i AND (e.resolved_i IS NULL OR e.resolved_i > b.i), LATERAL (SELECT e.scope = 'external' AND e.scope_confirmed_i <= b.i AS o)
WHERE abs(b.close - e.price) <= atr * CASE WHEN o THEN 0.75 ELSE 0.5 END GROUP BY b.symbol, b.i""")
def g1_nearest_level(spark, sf_dir):
    bars = kept(measured(spark, sf_dir), "measured")
    return L.nearest(bars, L.levels(bars)).select(*KEY, "i", "internal_i", "external_i")


@query("""SELECT symbol, 60 AS tf, i, time, state, confidence FROM regime_ WHERE i >= 0""")
def g3_regime(spark, sf_dir):
    bars = kept(measured(spark, sf_dir), "measured")
    return G.regime(bars, kept(L.levels(bars), "levels"), kept(breaks(bars), "breaks"))


@query(""", st AS (
  SELECT b.symbol, b.i, b.close, (high + low) / 2 AS up, (high + low) / 2 AS down, 1 AS d FROM bars b WHERE i = 0
  UNION ALL
  SELECT symbol, i, close, CASE WHEN bu < up OR pc > up THEN bu ELSE up END, CASE WHEN bl > down OR pc < down THEN bl ELSE down END, CASE WHEN d = -1 AND close > up THEN 1 WHEN d = 1 AND close < down THEN -1 ELSE d END
  FROM (SELECT b.symbol, b.i, b.close, s.close AS pc, s.up, s.down, s.d, (b.high + b.low) / 2 + 3 * coalesce(a.atr, 0) AS bu, (b.high + b.low) / 2 - 3 * coalesce(a.atr, 0) AS bl
        FROM st s JOIN bars b ON b.symbol = s.symbol AND b.i = s.i + 1 LEFT JOIN atr10 a ON a.symbol = b.symbol AND a.i = b.i))
SELECT symbol, 60 AS tf, i, round(CASE d WHEN 1 THEN down ELSE up END, 6) AS st_value, d AS st_direction FROM st""")
def t1_supertrend(spark, sf_dir):
    return measured(spark, sf_dir).select(*KEY, "i", "st_value", "st_direction")


@query("""SELECT h.symbol, 60 AS tf, h.i, now AS ht_trend, round(v, 6) AS ht_value, round(v + coalesce(a.atr, 0), 6) AS ht_high, round(v - coalesce(a.atr, 0), 6) AS ht_low, flipped AS ht_flipped
FROM (SELECT *, CASE now WHEN 0 THEN up ELSE down END AS v FROM half_ WHERE i >= 0) h LEFT JOIN atr10 a ON a.symbol = h.symbol AND a.i = h.i""")
def t2_halftrend(spark, sf_dir):
    return measured(spark, sf_dir).select(*KEY, "i", "ht_trend", "ht_value", "ht_high", "ht_low", "ht_flipped")


@query(""", em AS (SELECT symbol, i, high - low AS e FROM bars WHERE i = 0 UNION ALL SELECT b.symbol, b.i, (b.high - b.low) * (2.0::DOUBLE / 101) + e.e * (1 - 2.0::DOUBLE / 101) FROM em e JOIN bars b ON b.symbol = e.symbol AND b.i = e.i + 1),
rf AS (
  SELECT symbol, i, close AS f, 0 AS d FROM bars WHERE i = 0
  UNION ALL
  SELECT symbol, i, nf, CASE WHEN nf > f THEN 1 WHEN nf < f THEN -1 ELSE d END FROM (
    SELECT b.symbol, b.i, r.f, r.d, CASE WHEN b.close > r.f THEN greatest(r.f, b.close - 3 * e.e) WHEN b.close < r.f THEN least(r.f, b.close + 3 * e.e) ELSE r.f END AS nf
    FROM rf r JOIN bars b ON b.symbol = r.symbol AND b.i = r.i + 1 JOIN em e ON e.symbol = b.symbol AND e.i = b.i))
SELECT symbol, 60 AS tf, i, round(f, 6) AS rf_value, d AS rf_direction FROM rf""")
def t3_range_filter(spark, sf_dir):
    return measured(spark, sf_dir).select(*KEY, "i", "rf_value", "rf_direction")


def found_signals(spark, sf_dir):
    return T.signals(T.directions(measured(spark, sf_dir)), T.SignalConfig(main="halftrend", confirmations=("supertrend",), mode="OR", expiry=5))


@query("""SELECT f.symbol, 60 AS tf, f.i, w.time, CASE WHEN f.main > 0 THEN 'LONG' ELSE 'SHORT' END AS side, f.trigger_i, f.trigger_i + 5 AS expires_i, 1 AS passed, 1.0::DOUBLE AS confidence
FROM found_ f JOIN ways w ON w.symbol = f.symbol AND w.i = f.i""")
def t5_signals(spark, sf_dir):
    return found_signals(spark, sf_dir)


@query("""SELECT o.symbol, o.tf, o.type, o.scope, o.direction, o.triggered_by, o.boosted, round(o.probability_weight, 6) AS probability_weight, o.i, round(o.top, 6) AS top, round(o.bottom, 6) AS bottom, o.confirmed_i,
       z.volume AS zone_volume, l.s[floor((len(l.s) - 1) * 0.7 + 0.5)::INT + 1] AS least, CASE o.direction WHEN 'bear' THEN 'supply' ELSE 'demand' END AS zone
FROM obs o JOIN bars z ON z.symbol = o.symbol AND z.i = o.i
JOIN (SELECT a.symbol, a.i, list_sort(list(b.volume) FILTER (b.volume > 0)) AS s FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 99 AND a.i GROUP BY a.symbol, a.i) l ON l.symbol = o.symbol AND l.i = o.confirmed_i
WHERE z.volume >= coalesce(l.s[floor((len(l.s) - 1) * 0.7 + 0.5)::INT + 1], 0)""")
def t8_supply_demand(spark, sf_dir):
    bars = once(spark, sf_dir)
    return T.supply_demand(S.order_blocks(bars, lifted(spark, sf_dir, bars)), bars)


def backtested(spark, sf_dir, curve=False):
    return T.backtest(measured(spark, sf_dir), found_signals(spark, sf_dir), T.BacktestConfig(commission_bps=2, slippage_bps=1), curve=curve)


@query("""SELECT symbol, 60 AS tf, tsig AS signal_i, tei AS i, i AS exit_i, CASE WHEN tway > 0 THEN 'LONG' ELSE 'SHORT' END AS side, round(tentry, 6) AS entry_price, round(price, 6) AS exit_price, reason, round(net, 6) AS net_pnl, round(equity, 6) AS equity
FROM book_ WHERE traded""")
def b1_trades(spark, sf_dir):
    return backtested(spark, sf_dir).where("row = 'trade'").select(*KEY, "signal_i", "i", "exit_i", "side", "entry_price", "exit_price", "reason", "net_pnl", "equity")


@query("""SELECT symbol, 60 AS tf, i - 1 AS signal_i, i, CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END AS side, skipped AS reason FROM book_ WHERE skipped IS NOT NULL
UNION ALL
SELECT f.symbol, 60, f.i, f.i + 1, CASE WHEN f.main > 0 THEN 'LONG' ELSE 'SHORT' END, 'no_next_open' FROM found_ f JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) e ON e.symbol = f.symbol AND f.i = e.n""")
def b6_skipped(spark, sf_dir):
    return backtested(spark, sf_dir).where("row = 'skipped'").select(*KEY, "signal_i", "i", "side", "reason")


@query("""SELECT symbol, 60 AS tf, trades, wins, round(net_pnl, 6) AS net_pnl, round(gain, 6) AS gross_profit, round(loss, 6) AS gross_loss, trades - wins AS losses, round(CASE WHEN trades > 0 THEN wins / trades ELSE 0 END, 6) AS win_rate,
       round(CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN NULL ELSE 0 END, 6) AS profit_factor, round(dd, 6) AS max_drawdown, round(final, 6) AS final_equity, round((final / 10000 - 1) * 100, 6) AS return_pct FROM (
  SELECT symbol, count(*) FILTER (traded) AS trades, count(*) FILTER (traded AND net > 0) AS wins, coalesce(sum(net) FILTER (traded), 0) AS net_pnl, coalesce(sum(net) FILTER (traded AND net > 0), 0) AS gain, coalesce(-sum(net) FILTER (traded AND net < 0), 0) AS loss,
         max((peak - marked) / peak) AS dd, arg_max(marked, i) AS final
  FROM (SELECT *, greatest(max(marked) OVER (PARTITION BY symbol ORDER BY i), 10000) AS peak FROM book_ WHERE i >= 0) GROUP BY symbol)""")
def b7_summary(spark, sf_dir):
    return T.summary(backtested(spark, sf_dir, curve=True))


# ---- levels, profiles, vwap ---------------------------------------------------------------------------------------


@query()
def z1_zona(spark, sf_dir):
    return Z.zone_levels(P.internal_zigzag(measured(spark, sf_dir)), 150)


@query("""SELECT symbol, 60 AS tf, ratio, round(price, 6) AS price, abs(price - close) <= close * 0.005 AS near_price FROM (
  SELECT z.symbol, r.ratio, CASE WHEN l.i < h.i THEN h.p - (h.p - l.p) * r.ratio ELSE l.p + (h.p - l.p) * r.ratio END AS price, c.close FROM (
    SELECT symbol, arg_max({'i': i, 'p': price}, i) FILTER (kind = 'high') AS h, arg_max({'i': i, 'p': price}, i) FILTER (kind = 'low') AS l FROM zz GROUP BY symbol) z
  CROSS JOIN unnest([0.0::DOUBLE, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]) r(ratio) JOIN (SELECT symbol, arg_max(close, i) AS close FROM bars GROUP BY symbol) c ON c.symbol = z.symbol WHERE h IS NOT NULL AND l IS NOT NULL)""")
def z2_fib(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return Z.fibonacci(P.compress(external(bars)), bars)


@query("""SELECT symbol, 60 AS tf, unnest([{'type': 'PDH', 'price': round(h, 6)}, {'type': 'PDL', 'price': round(l, 6)}], recursive := true), available_i FROM (
  SELECT symbol, min(i) AS available_i, lag(max(high)) OVER w AS h, lag(min(low)) OVER w AS l FROM bars GROUP BY symbol, time // 86400 WINDOW w AS (PARTITION BY symbol ORDER BY time // 86400)) WHERE h IS NOT NULL""")
def z5_prev_hl(spark, sf_dir):
    return Z.previous_high_low(hourly(spark, sf_dir), "D").select(*KEY, "type", "price", "available_i")




@query(f"""SELECT symbol, tf, segment, bin, round(sum(CASE WHEN high > low THEN volume * greatest(least(lo + (bin + 1) * step, high) - greatest(lo + bin * step, low), 0) / (high - low) ELSE volume END), 6) AS volume FROM (
  SELECT d.*, lo, (hi - lo) / 24 AS step, unnest(range(least(greatest(((low - lo) / ((hi - lo) / 24))::BIGINT - (((low - lo) / ((hi - lo) / 24))::BIGINT > (low - lo) / ((hi - lo) / 24))::INT, 0), 23),
                                          CASE WHEN high > low THEN least(greatest(floor((high - lo) / ((hi - lo) / 24))::BIGINT, 0), 23) ELSE least(greatest(floor((low - lo) / ((hi - lo) / 24))::BIGINT, 0), 23) END + 1)) AS bin
  FROM {DAYS} d JOIN (SELECT symbol, segment, min(low) AS lo, max(high) AS hi FROM {DAYS} GROUP BY ALL) USING (symbol, segment) WHERE hi > lo) GROUP BY symbol, tf, segment, bin""")
def a2_volume_profile(spark, sf_dir):
    binned = A.bins(A.session_segments(hourly(spark, sf_dir)))
    return binned.where("volume > 0").select(*KEY, "segment", "bin", "volume")


@query("""SELECT symbol, 60 AS tf, v.segment, e.segment_end, round(total, 6) AS total, round(CASE WHEN e.h > e.l THEN lo + (poc + 0.5) * step ELSE e.l END, 6) AS poc, round(lo + (b + 1) * step, 6) AS vah, round(lo + a * step, 6) AS val
FROM value_ v JOIN (SELECT symbol, segment, max(i) AS segment_end, min(low) AS l, max(high) AS h FROM DAYS_ GROUP BY ALL) e USING (symbol, segment)""")
def a3_value_area(spark, sf_dir):
    return A.value_area(A.bins(A.session_segments(hourly(spark, sf_dir)))).drop("max_volume")


@query("""SELECT symbol, 60 AS tf, segment, round(poc, 6) AS poc, arg_min(d.i, (abs((d.high + d.low + d.close) / 3 - poc), d.i)) AS poc_i FROM (
  SELECT symbol, v.segment, CASE WHEN e.h > e.l THEN lo + (poc + 0.5) * step ELSE e.l END AS poc FROM value_ v JOIN (SELECT symbol, segment, min(low) AS l, max(high) AS h FROM DAYS_ GROUP BY ALL) e USING (symbol, segment)) p
JOIN DAYS_ d USING (symbol, segment) GROUP BY symbol, segment, poc""")
def a4_poc_index(spark, sf_dir):
    days = A.session_segments(hourly(spark, sf_dir))
    return A.poc_index(A.value_area(A.bins(days)), days).select(*KEY, "segment", "poc", "poc_i")


@query(f"""SELECT symbol, 60 AS tf, i, segment, round(m + 3e-8, 6) AS vwap, round(sqrt(sum(v * (tp - m) ** 2) / sum(v)), 6) AS sigma FROM (
  SELECT a.symbol, a.i, a.segment, b.volume AS v, (b.high + b.low + b.close) / 3 AS tp, sum(v * tp) OVER w / sum(v) OVER w AS m
  FROM {DAYS} a JOIN {DAYS} b ON a.symbol = b.symbol AND a.segment = b.segment AND b.i <= a.i WINDOW w AS (PARTITION BY a.symbol, a.i)) GROUP BY symbol, i, segment, m""")
def a7_vwap(spark, sf_dir):
    return A.vwap(A.session_segments(hourly(spark, sf_dir))).select(*KEY, "i", "segment", (F.col("vwap") + 3e-8).alias("vwap"), "sigma")


@query("""SELECT symbol, 60 AS tf, min(i) AS i, 'session_start' AS source FROM bars GROUP BY symbol, time // 86400
UNION ALL SELECT symbol, 60, coalesce(min(i) FILTER (time % 86400 >= 34200), min(i)), 'market_open' FROM bars b GROUP BY symbol, time // 86400
HAVING min(i) FILTER (time % 86400 >= 34200) IS NOT NULL OR time // 86400 < (SELECT max(time // 86400) FROM bars x WHERE x.symbol = b.symbol)""")
def a8_anchors(spark, sf_dir):
    return A.anchors(hourly(spark, sf_dir)).drop("metadata")


@query(f"""SELECT a.symbol, 60 AS tf, a.i, a.segment, round(m + 3e-8, 6) AS vwap, round(sqrt(greatest(sum(b.volume * (tp - m) ** 2) / sum(b.volume), 0)), 6) AS sigma FROM (
  SELECT a.symbol, a.i, a.segment, sum(b.volume * (b.high + b.low + b.close) / 3) / sum(b.volume) AS m FROM LINES_ a JOIN LINES_ b ON b.symbol = a.symbol AND b.segment = a.segment AND b.i <= a.i GROUP BY ALL) a
JOIN (SELECT *, (high + low + close) / 3 AS tp FROM LINES_) b ON b.symbol = a.symbol AND b.segment = a.segment AND b.i <= a.i GROUP BY a.symbol, a.i, a.segment, m""".replace("LINES_", "(SELECT b.*, (SELECT max(k.i) FROM marks_ k WHERE k.symbol = b.symbol AND k.i <= b.i) AS segment FROM bars b)"))
def a9_anchor_lines(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    found = A.anchors(bars).unionByName(A.event_anchors(breaks(bars)))
    return A.lines(bars, A.merged(found, bars)).select(*KEY, "i", "segment", (F.col("vwap") + 3e-8).alias("vwap"), "sigma")


@query()
def a10_missed_anchor(spark, sf_dir):
    return A.missed_anchor(P.missed_pivots(hourly(spark, sf_dir), 5), 150)


@query("""SELECT *, round(sqrt(greatest((SELECT sum(b.volume * ((b.high + b.low + b.close) / 3 - m) ** 2) / sum(b.volume) FROM bars b WHERE b.symbol = r.symbol AND b.i BETWEEN r.first AND r.last), 0)), 6) AS sigma FROM (
  SELECT a.symbol, 60 AS tf, a.i AS last, a.i - 19 AS first, round(sum(b.volume * (b.high + b.low + b.close) / 3) / sum(b.volume) + 3e-8, 6) AS vwap, sum(b.volume * (b.high + b.low + b.close) / 3) / sum(b.volume) AS m
  FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 19 AND a.i WHERE a.i >= 19 GROUP BY a.symbol, a.i) r""".replace("SELECT *, round(sqrt", "SELECT symbol, tf, last, first, vwap, round(sqrt"))
def a12_range_vwap(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return A.range_vwap(bars, bars.where("i >= 19").select(*KEY, F.col("i").alias("last"), (F.col("i") - 19).alias("first"))).withColumn("vwap", F.col("vwap") + 3e-8)


# ---- features and models ------------------------------------------------------------------------------------------


def ghost_events(spark, sf_dir):
    return P.ghost_trace(hourly(spark, sf_dir), 5)


GHOST = "(" + ORACLE["p17_ghost_trace"][ORACLE["p17_ghost_trace"].index("SELECT symbol, 60 AS tf, event_i") :] + ")"


@query(f"""SELECT symbol, tf, event_i, """ + ", ".join(f'count(*) OVER (PARTITION BY symbol ORDER BY event_time RANGE BETWEEN 1 FOLLOWING AND {n * 3600} FOLLOWING) AS "Y_{n * 60}m"' for n in (3, 5, 10, 15)) + f""",
  (SELECT max(time) FROM bars b WHERE b.symbol = g.symbol) >= event_time + 54000 AS complete FROM {GHOST} g""")
def f2_labels(spark, sf_dir):
    return X.labels(ghost_events(spark, sf_dir), hourly(spark, sf_dir), (180, 300, 600, 900)).select(*KEY, "event_i", "Y_180m", "Y_300m", "Y_600m", "Y_900m", "complete")


@query("""SELECT b.symbol, 60 AS tf, b.i, max(m.i) AS closed_i FROM bars b LEFT JOIN minutes m ON m.symbol = b.symbol AND m.time + 60 <= b.time GROUP BY b.symbol, b.i""")
def f3_last_closed(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return X.last_closed(bars, minutes(spark, sf_dir), 1, "time").select(*KEY, "i", "closed_i")


@query(f"""SELECT symbol, tf, event_i, event_time, cursor, round(ref, 6) AS ref, round((level_sh - ref) / 0.25, 6) AS level_sh_pips, round((level_sl - ref) / 0.25, 6) AS level_sl_pips, round((gap_bull - ref) / 0.25, 6) AS gap_bull_pips,
       round((gap_bear - ref) / 0.25, 6) AS gap_bear_pips, round((block_bull - ref) / 0.25, 6) AS block_bull_pips, round((block_bear - ref) / 0.25, 6) AS block_bear_pips FROM (
  SELECT p.symbol, p.tf, p.event_i, p.event_time, p.cursor, p.ref, {', '.join(f"arg_min(z.mid, (abs(z.mid - p.ref), z.tie)) FILTER (z.what = '{w}') AS {w}" for w in ("level_sh", "level_sl", "gap_bull", "gap_bear", "block_bull", "block_bear"))}
  FROM (SELECT e.symbol, e.tf, e.event_i, e.event_time, e.event_i - 1 AS cursor, (g.high + g.low + g.close) / 3 AS ref FROM ({GHOST}) e JOIN bars g ON g.symbol = e.symbol AND g.i = e.ghost_i WHERE e.event_i >= 1) p
  LEFT JOIN (
    SELECT symbol, 'level_' || side AS what, price AS mid, -price AS tie, confirmed_i, resolved_i AS end_i FROM ends
    UNION ALL
    SELECT f.symbol, f.what || '_' || f.direction, (f.top + f.bottom) / 2, -f.confirmed_i, f.confirmed_i, min(b.i) FROM (
      SELECT 'gap' AS what, symbol, direction, top, bottom, confirmed_i, i AS k FROM fvg UNION ALL SELECT 'block', symbol, direction, top, bottom, confirmed_i, row_number() OVER () FROM obs) f
    LEFT JOIN bars b ON b.symbol = f.symbol AND b.i > f.confirmed_i AND f.top > f.bottom AND CASE f.direction WHEN 'bull' THEN b.low <= f.bottom ELSE b.high >= f.top END
    GROUP BY f.symbol, f.what, f.direction, f.top, f.bottom, f.confirmed_i, f.k) z ON z.symbol = p.symbol AND z.confirmed_i <= p.cursor AND (z.end_i IS NULL OR z.end_i > p.cursor)
  GROUP BY ALL)""")
def f8_snapshot_1h(spark, sf_dir):
    bars = once(spark, sf_dir)
    blocks = S.lifecycle(bars, S.order_blocks(bars, lifted(spark, sf_dir, bars)))
    return X.snapshot(P.ghost_trace(bars, 5), bars, L.levels(bars), S.lifecycle(bars, S.gaps(bars)), blocks)


#: Three timeframes as series of their own (symbol|minutes), so that the parts above hold for all of them.
FRAMES = {
    "bars": """SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time) - 1)::INT AS i FROM (
        SELECT symbol || '|' || m AS symbol, m AS tf, es // (m * 60) * (m * 60) AS time, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low,
               arg_max(px, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM ev, (VALUES (1), (10), (60)) AS t(m) GROUP BY ALL)""",
    "pv9": pivot_sql(10),
    "tied": pivot_sql(50, True),
}
PARTS |= {
    "triples_": """SELECT * FROM (
          SELECT a.symbol, a.i AS ai, a.price AS ap, c.i AS ci, c.price AS cp, c.confirmed_i AS e, c.z, a.z AS az, (c.price - a.price) / (c.i - a.i) AS slope, (tc.time - ta.time) / 60 AS minutes,
                 row_number() OVER (PARTITION BY c.symbol, c.z ORDER BY a.z DESC) AS try
          FROM LOWS_ c JOIN LOWS_ a ON a.symbol = c.symbol AND a.z BETWEEN c.z - 30 AND c.z - 2 JOIN bars tc ON tc.symbol = c.symbol AND tc.i = c.i JOIN bars ta ON ta.symbol = a.symbol AND ta.i = a.i
          WHERE tc.time - ta.time >= 7200) WHERE try <= 3""",
    "middles_": """SELECT t.*, m.i AS mi, m.price AS mp FROM triples_ t JOIN LOWS_ m ON m.symbol = t.symbol AND m.z > t.az AND m.z < t.z AND m.price > least(ap, cp) AND m.price < greatest(ap, cp)
        QUALIFY row_number() OVER (PARTITION BY t.symbol, t.z, t.az ORDER BY abs(m.price - ap - slope * (m.i - ai)), m.z) = 1""",
    "widths_": """SELECT m.symbol, m.z, m.az, m.ai, m.mi, m.ci, m.ap, m.slope, m.e, m.minutes, m.try, m.mp, m.cp, avg(x.atr) FILTER (x.atr > 0) AS mean, max(b.high - (m.ap + m.slope * (b.i - m.ai))) AS width
        FROM middles_ m JOIN bars b ON b.symbol = m.symbol AND b.i BETWEEN m.ai AND m.e LEFT JOIN atr x ON x.symbol = b.symbol AND x.i = b.i GROUP BY ALL""",
    "inside_": """SELECT w.*, avg((b.low >= ap + slope * (b.i - ai) - 0.25 * coalesce(x.atr, mean) AND b.high <= ap + slope * (b.i - ai) + width + 0.25 * coalesce(x.atr, mean))::INT) AS share
        FROM widths_ w JOIN bars b ON b.symbol = w.symbol AND b.i BETWEEN w.ai AND w.e LEFT JOIN atr x ON x.symbol = b.symbol AND x.i = b.i
        WHERE mean IS NOT NULL AND abs(mp - (ap + slope * (mi - ai))) <= 0.25 * mean AND ap + mp + cp <> 0 AND mean / abs((ap + mp + cp) / 3) <= 1.0 AND width > 0.75 * mean AND width < 8 * mean GROUP BY ALL""",
    "three_": """SELECT w.symbol, w.ai AS base_i, w.mi AS middle_i, w.ci AS last_i, w.ap AS base_price, w.slope, w.width, w.e AS confirmed_i, w.minutes,
               min(b.i) FILTER (b.close < ap + slope * (b.i - ai) - 0.25 * coalesce(x.atr, mean) OR b.close > ap + slope * (b.i - ai) + width + 0.25 * coalesce(x.atr, mean)) AS break_i
        FROM (SELECT * FROM inside_ WHERE share >= 0.85 QUALIFY row_number() OVER (PARTITION BY symbol, z ORDER BY try) = 1) w
        LEFT JOIN bars b ON b.symbol = w.symbol AND b.i > w.e LEFT JOIN atr x ON x.symbol = b.symbol AND x.i = b.i
        GROUP BY w.symbol, w.z, w.ai, w.mi, w.ci, w.ap, w.slope, w.width, w.e, w.minutes""",
    "ghosts_": f"SELECT * FROM ({ORACLE['p17_ghost_trace'][ORACLE['p17_ghost_trace'].index('SELECT symbol, 60 AS tf, event_i'):]}) WHERE symbol LIKE '%|1'",
    "asked_": """SELECT *, split_part(symbol, '|', 1) AS name FROM (
          SELECT e.*, (g.high + g.low + g.close) / 3 AS ref, b.volume, a.atr, row_number() OVER (PARTITION BY e.symbol ORDER BY e.event_i) - 1 AS serial, (SELECT max(time) FROM bars x WHERE x.symbol = e.symbol) >= e.event_time + 900 AS complete,
                 COUNTS_
          FROM ghosts_ e JOIN bars g ON g.symbol = e.symbol AND g.i = e.ghost_i JOIN bars b ON b.symbol = e.symbol AND b.i = e.event_i LEFT JOIN atr a ON a.symbol = e.symbol AND a.i = e.event_i)
        WHERE atr IS NOT NULL AND complete""".replace("COUNTS_", ", ".join(f"count(*) OVER (PARTITION BY e.symbol ORDER BY e.event_time RANGE BETWEEN 1 FOLLOWING AND {n * 60} FOLLOWING) AS y{n}" for n in (3, 5, 10, 15))),
    "cursors_": """SELECT p.name, p.event_i, p.ref, t.m, p.name || '|' || t.m AS symbol, max(b.i) AS cursor FROM asked_ p, (VALUES (1), (10), (60)) AS t(m)
        JOIN bars b ON b.symbol = p.name || '|' || t.m AND b.time + t.m * 60 <= p.event_time GROUP BY ALL""",
    "zones_": """SELECT f.what, f.symbol, f.i, f.direction, f.top, f.bottom, f.confirmed_i, f.k, min(b.i) AS end_i FROM (
          SELECT 'fvg' AS what, symbol, direction, top, bottom, confirmed_i, i, i AS k FROM fvg UNION ALL SELECT 'ob', symbol, direction, top, bottom, confirmed_i, i, row_number() OVER () FROM obs) f
        LEFT JOIN bars b ON b.symbol = f.symbol AND b.i > f.confirmed_i AND f.top > f.bottom AND CASE f.direction WHEN 'bull' THEN b.low <= f.bottom ELSE b.high >= f.top END GROUP BY ALL""",
    "recent_": "SELECT a.symbol, a.i, list_sort(list(b.volume) FILTER (b.volume > 0)) AS s FROM bars a JOIN bars b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 99 AND a.i GROUP BY a.symbol, a.i",
    "twins_": """SELECT n.symbol, n.side, n.i, p.i AS p_i, (p.price + n.price) / 2 AS eq_price, greatest(p.confirmed_i, n.confirmed_i) AS known FROM (SELECT l.*, a.atr FROM levels l JOIN atr_late a USING (symbol, i)) n
        JOIN (SELECT l.*, a.atr FROM levels l LEFT JOIN atr_late a USING (symbol, i)) p ON p.symbol = n.symbol AND p.side = n.side AND p.i < n.i AND n.i - p.i <= 100
        WHERE abs(p.price - n.price) <= 0.05 * coalesce((p.atr + n.atr) / 2, n.atr) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = n.symbol AND b.i > p.confirmed_i AND b.i < n.i
          AND CASE n.side WHEN 'sh' THEN b.high > p.price + 0.05 * coalesce((p.atr + n.atr) / 2, n.atr) ELSE b.low < p.price - 0.05 * coalesce((p.atr + n.atr) / 2, n.atr) END)
        QUALIFY row_number() OVER (PARTITION BY n.symbol, n.side, n.i ORDER BY p.i DESC) = 1""",
    "equals_": """SELECT e.symbol, coalesce(o.eq_price, e.price) AS price, least(o.known, q.known) AS known, e.swept_i FROM (SELECT l.*, s.swept_i FROM levels l LEFT JOIN sweeps s USING (symbol, kind, i)) e
        LEFT JOIN twins_ o ON o.symbol = e.symbol AND o.side = e.side AND o.i = e.i LEFT JOIN (SELECT symbol, side, p_i, min(known) AS known FROM twins_ GROUP BY ALL) q ON q.symbol = e.symbol AND q.side = e.side AND q.p_i = e.i
        WHERE o.known IS NOT NULL OR q.known IS NOT NULL""",
    "streams_": """SELECT what, symbol, (top + bottom) / 2 AS v, confirmed_i::DOUBLE AS tie, abs(top - bottom) AS width, confirmed_i AS first, end_i - 1 AS last FROM zones_
        UNION ALL SELECT 'supply_demand', z.symbol, (top + bottom) / 2, confirmed_i, abs(top - bottom), confirmed_i, end_i - 1 FROM zones_ z JOIN bars o ON o.symbol = z.symbol AND o.i = z.i JOIN recent_ l ON l.symbol = z.symbol AND l.i = z.confirmed_i
          WHERE z.what = 'ob' AND o.volume >= coalesce(l.s[floor((len(l.s) - 1) * 0.7 + 0.5)::INT + 1], 0)
        UNION ALL SELECT 'structure', symbol, level, level, 0, i, i + 500 FROM broken
        UNION ALL SELECT 'resolved', symbol, price, price, 0, resolved_i, resolved_i + 500 FROM ends WHERE resolved_i IS NOT NULL AND classification IS NOT NULL
        UNION ALL SELECT 'equal', symbol, price, price, 0, known, swept_i - 1 FROM equals_""",
    "nearest_": """SELECT c.name, c.event_i, c.m, s.what, arg_min((s.v, s.width), (abs(s.v - c.ref), -s.tie, s.width)) AS x FROM cursors_ c JOIN streams_ s ON s.symbol = c.symbol AND s.first <= c.cursor AND (s.last IS NULL OR s.last >= c.cursor) GROUP BY ALL""",
    "turned_": """SELECT symbol, confirmed_i, arg_max(h, (i, kind)) AS h, arg_max(l, (i, kind)) AS l, arg_max(kind, (i, kind)) AS kind FROM (
          SELECT *, last_value(CASE kind WHEN 'high' THEN {'i': i, 'p': price} END IGNORE NULLS) OVER w AS h, last_value(CASE kind WHEN 'low' THEN {'i': i, 'p': price} END IGNORE NULLS) OVER w AS l FROM pv9
          WINDOW w AS (PARTITION BY symbol ORDER BY confirmed_i, i, kind ROWS UNBOUNDED PRECEDING)) GROUP BY symbol, confirmed_i""",
    "legs_": """SELECT c.*, CASE t.kind WHEN 'high' THEN t.h ELSE t.l END AS a, CASE t.kind WHEN 'high' THEN t.l ELSE t.h END AS b FROM cursors_ c ASOF JOIN turned_ t ON t.symbol = c.symbol AND c.cursor >= t.confirmed_i""",
    "vwaps_": """SELECT name, event_i, m, vwap, sqrt(greatest(sum(b.volume * ((b.high + b.low + b.close) / 3 - vwap) ** 2) / sum(b.volume), 0)) AS sd FROM (
          SELECT l.name, l.event_i, l.m, l.symbol, l.cursor, l.b.i AS start, sum(b.volume * (b.high + b.low + b.close) / 3) / sum(b.volume) AS vwap FROM legs_ l JOIN bars b ON b.symbol = l.symbol AND b.i BETWEEN l.b.i AND l.cursor GROUP BY ALL) v
        JOIN bars b ON b.symbol = v.symbol AND b.i BETWEEN v.start AND v.cursor GROUP BY name, event_i, m, vwap""",
    "parts_": "SELECT b.*, {'f': s.f, 't': s.t} AS segment FROM (SELECT DISTINCT symbol, least(a.i, b.i) AS f, greatest(a.i, b.i) AS t FROM legs_ WHERE b IS NOT NULL) s JOIN bars b ON b.symbol = s.symbol AND b.i BETWEEN s.f AND s.t",
}
PARTS |= {k: v.replace("LOWS_", "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confirmed_i, i) - 1 AS z FROM pv3 WHERE kind = 'low')") for k, v in PARTS.items()}
FRAMES |= {k: PARTS[k].replace(DAYS, "parts_").replace("range(24)", "range(50)").replace("/ 24", "/ 50").replace(", 23)", ", 49)").replace("b < 23", "b < 49") for k in ("bins_", "area_", "value_")}


def with_parts(body: str, own: dict[str, str]) -> str:
    """with_() with some parts replaced."""
    before = {k: PARTS[k] for k in own}
    PARTS.update(own)
    try:
        return with_(body)
    finally:
        PARTS.update(before)


def _extract_sql() -> str:
    near = lambda prices: f"list_sort([{{'d': abs(z - p.ref), 'n': -z}} FOR z IN [{', '.join(prices)}] IF z IS NOT NULL])[1].n * -1"
    pips = lambda v: f"round(({v} - p.ref) / 0.25, 6)"
    kinds = {"ob": "ob", "fvg": "fvg", "structure": "bos_choch", "equal": "eqh_eql", "resolved": "sweep_grab_run", "supply_demand": "supply_demand"}
    columns, joins = [], []
    for m in (1, 10, 60):
        joins.append(f"LEFT JOIN legs_ l{m} ON l{m}.name = p.name AND l{m}.event_i = p.event_i AND l{m}.m = {m} AND l{m}.b IS NOT NULL LEFT JOIN vwaps_ v{m} ON v{m}.name = p.name AND v{m}.event_i = p.event_i AND v{m}.m = {m}")
        joins.append(f"LEFT JOIN value_ q{m} ON q{m}.symbol = p.name || '|{m}' AND q{m}.segment = {{'f': least(l{m}.a.i, l{m}.b.i), 't': greatest(l{m}.a.i, l{m}.b.i)}}")
        each = ", ".join(f"max(x) FILTER (what = '{k}') AS {k}" for k in kinds)
        joins.append(f"LEFT JOIN (SELECT name, event_i, {each} FROM nearest_ WHERE m = {m} GROUP BY ALL) n{m} ON n{m}.name = p.name AND n{m}.event_i = p.event_i")
        joins.append(f"""LEFT JOIN (SELECT c.name, c.event_i, arg_min({{'lo': base_price + slope * (cursor - base_i), 'w': width}}, (least(abs(base_price + slope * (cursor - base_i) - ref), abs(base_price + slope * (cursor - base_i) + width - ref)), confirmed_i, base_i)) AS x
            FROM cursors_ c JOIN three_ t ON t.symbol = c.symbol AND t.confirmed_i <= c.cursor AND (t.break_i IS NULL OR t.break_i > c.cursor) WHERE c.m = {m} GROUP BY ALL) k{m} ON k{m}.name = p.name AND k{m}.event_i = p.event_i""")
        own = {f"{out}_dist_pips": pips(f"n{m}.{k}[1]") for k, out in kinds.items()} | {f"{k}_width_pips": f"round(n{m}.{k}[2] / 0.25, 6)" for k in ("ob", "fvg", "supply_demand")}
        low, size = f"least(l{m}.a.p, l{m}.b.p)", f"abs(l{m}.a.p - l{m}.b.p)"
        own |= {"fib_dist_pips": f"CASE WHEN l{m}.b IS NOT NULL THEN {pips(near([f'{low} + {size} * {r}::DOUBLE' for r in E.RATIOS]))} END", "vwap_dist_pips": pips(f"v{m}.vwap")}
        own |= {f"vwap_band{n}_dist_pips": f"CASE WHEN v{m}.vwap IS NOT NULL THEN {pips(near([f'v{m}.vwap - {n} * v{m}.sd', f'v{m}.vwap + {n} * v{m}.sd']))} END" for n in (1, 2)}
        for c, at in (("poc", f"q{m}.lo + (q{m}.poc + 0.5) * q{m}.step"), ("vah", f"q{m}.lo + (q{m}.b + 1) * q{m}.step"), ("val", f"q{m}.lo + q{m}.a * q{m}.step")):
            own[f"vp_{c}_dist_pips"] = pips(at)
        own |= {"channel_dist_pips": f"CASE WHEN k{m}.x IS NOT NULL THEN {pips(near([f'k{m}.x.lo', f'k{m}.x.lo + k{m}.x.w']))} END", "channel_width_pips": f"round(abs(k{m}.x.w) / 0.25, 6)"}
        columns += [f"{own[c]} AS tf{m}_{c}" for c in E.OF_TIMEFRAME]
    for name, key in (("4h", "time // 14400"), ("d", "time // 86400"), ("w", "time // 86400 - (time // 86400 + 3) % 7")):
        joins.append(f"""LEFT JOIN (SELECT symbol, g, lag(h) OVER w AS h, lag(l) OVER w AS l FROM (SELECT symbol, {key} AS g, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY g)) r{name}
            ON r{name}.symbol = p.symbol AND r{name}.g = {key.replace('time', 'p.event_time')}""")
        columns.append(f"CASE WHEN r{name}.h IS NOT NULL THEN {pips(near([f'r{name}.h', f'r{name}.l']))} END AS sr_{name}_dist_pips")
    return f"""SELECT p.name AS symbol, concat_ws('_', 'ghost_relocated', ghost_type, p.event_i, ghost_i, serial) AS event_id, event_time AS event_timestamp, strftime(make_timestamp(event_time * 1000000), '%Y-%m-%d') AS event_date,
        (event_time % 86400 // 3600)::INT AS event_hour, (event_time % 3600 // 60)::INT AS event_minute, p.event_i AS event_index, ghost_i AS ghost_index, complete, round(ghost_price, 6) AS ghost_price, round(p.ref, 6) AS ghost_hlc3,
        round(p.atr, 6) AS atr_1m, p.volume AS volume_1m, round(em.e, 6) AS volume_ema9_1m, {', '.join(columns)}, ghost_type, relocation, y3 AS "Y_3m", y5 AS "Y_5m", y10 AS "Y_10m", y15 AS "Y_15m"
      FROM asked_ p LEFT JOIN (SELECT symbol, i, e FROM ema_) em ON em.symbol = p.symbol AND em.i = p.event_i {' '.join(joins)}"""


PARTS["ema_"] = """SELECT symbol, i, volume AS e FROM bars WHERE i = 0 UNION ALL SELECT b.symbol, b.i, 0.2 * b.volume + 0.8 * m.e FROM ema_ m JOIN bars b ON b.symbol = m.symbol AND b.i = m.i + 1"""


@query()
def f11_extract(spark, sf_dir):
    return E.extract(minutes(spark, sf_dir), channel_atr_share=1.0)


ORACLE["f11_extract"] = with_parts(_extract_sql(), FRAMES)


@query("""SELECT symbol, 60 AS tf, available_i, round(h, 6) AS resistance, round(l, 6) AS support FROM (
  SELECT symbol, min(i) AS available_i, lag(max(high)) OVER w AS h, lag(min(low)) OVER w AS l FROM bars GROUP BY symbol, time // 14400 WINDOW w AS (PARTITION BY symbol ORDER BY time // 14400)) WHERE h IS NOT NULL""")
def f9_sr(spark, sf_dir):
    return Z.support_resistance(hourly(spark, sf_dir)).select(*KEY, "available_i", "resistance", "support")


NUMBERS = ("trend_return", "volatility", "volume_ratio")


@query("SELECT symbol, tf, i, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM features)) / (SELECT stddev_pop({c}) FROM features), 6) AS {c}_z" for c in NUMBERS) + ", (symbol = 'view')::INT AS is_view FROM features")
def n1_impute_scale(spark, sf_dir):
    rows = features(spark, sf_dir)
    out = X.scale(rows, X.fit_scaler(rows, NUMBERS), NUMBERS, {"symbol": ("view",)})
    return out.select(*KEY, "i", *[f"{c}_z" for c in NUMBERS], F.col("`symbol=view`").alias("is_view"))


@query("""SELECT symbol, tf, i, n, round(total, 6) AS total FROM (SELECT symbol, tf, i, count(*) OVER w AS n, sum(volume_ratio + atr_pct) OVER w AS total FROM features WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 15 PRECEDING)) WHERE n = 16""")
def n2_sequences(spark, sf_dir):
    out = X.sequences(features(spark, sf_dir), ("volume_ratio", "atr_pct"), "i", 16)
    return out.select(*KEY, "i", F.size("sequence").cast("long").alias("n"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + F.get(x, F.lit(0)) + F.get(x, F.lit(1))).alias("total"))


@query("SELECT symbol, part, count(*) AS n FROM (SELECT *, CASE WHEN r > floor(c * 0.8) THEN 'validation' WHEN time + 7200 > s THEN 'purged' ELSE 'train' END AS part FROM (SELECT *, min(CASE WHEN r > floor(c * 0.8) THEN time END) OVER (PARTITION BY symbol) AS s FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM bars))) GROUP BY ALL")
def n5_temporal_split(spark, sf_dir):
    return X.temporal_split(hourly(spark, sf_dir), "time", 0.8, 7200).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT symbol, 60 AS tf, i, least(greatest(y1, 0), 3)::DOUBLE AS y1, least(greatest(least(greatest(y2, 0), 5), least(greatest(y1, 0), 3)), 5)::DOUBLE AS y2 FROM (SELECT symbol, i, round(close - open, 6) AS y1, round(high - close, 6) AS y2 FROM bars)""")
def n6_constraints(spark, sf_dir):
    rows = hourly(spark, sf_dir).select(*KEY, "i", F.round(F.col("close") - F.col("open"), 6).alias("y1"), F.round(F.col("high") - F.col("close"), 6).alias("y2"))
    return X.constrained(rows, ("y1", "y2"), (3, 5))


@query("""SELECT symbol, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg((abs(round_even(p, 0) - a) = 0)::INT), 6) AS exact, round(100 * avg((abs(round_even(p, 0) - a) <= 1)::INT), 6) AS within_one, round(1 - sum(e * e) / (var_pop(a) * count(*)), 6) AS r2
FROM (SELECT symbol, volume AS a, m AS p, m - volume AS e FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM bars) WHERE i >= 20) GROUP BY symbol""")
def n7_metrics(spark, sf_dir):
    from ..operators.core import rows_between

    rows = hourly(spark, sf_dir).withColumn("m", F.avg("volume").over(rows_between(-20, -1))).where("i >= 20")
    return X.metrics(rows, "volume", "m", ("symbol",))


@query("SELECT symbol, tf, i, round((return_1 - m) / CASE WHEN s * s > 1e-24 THEN s ELSE 1 END, 6) AS z FROM features JOIN (SELECT symbol, avg(return_1) AS m, stddev_pop(return_1) AS s FROM features WHERE available GROUP BY symbol) USING (symbol)")
def c1_zscore(spark, sf_dir):
    rows = features(spark, sf_dir)
    stats = rows.where("available").groupBy(*KEY).agg(F.avg("return_1").alias("m"), F.stddev_pop("return_1").alias("s"))
    sd = F.when(F.col("s") * F.col("s") > 1e-24, F.col("s")).otherwise(1.0)
    return rows.join(stats, KEY).select(*KEY, "i", ((F.col("return_1") - F.col("m")) / sd).alias("z"))


@query()
def c3_kmeans_predict(spark, sf_dir):
    return M.regimes(features(spark, sf_dir))


@query()
def c8_gmm_hmm(spark, sf_dir):
    return M.regimes(features(spark, sf_dir), method="gmm_hmm")


@query()
def c8_walk_forward(spark, sf_dir):
    return M.regimes(features(spark, sf_dir), method="gmm_hmm", refit=1)


@query()
def t10_trend_channels(spark, sf_dir):
    from ..operators import channels

    return channels.channels(measured(spark, sf_dir))


@query("""SELECT symbol, 60 AS tf, base_i, middle_i, last_i, round(base_price, 6) AS base_price, round(slope, 6) AS slope, round(width, 6) AS width, confirmed_i, break_i, round(minutes, 6) AS minutes FROM three_""")
def t11_three_low_channels(spark, sf_dir):
    from ..operators import channels

    bars = measured(spark, sf_dir)
    return channels.three_low_channels(bars, P.pivots(bars, 3), atr_share=1.0)


@query("""SELECT symbol, tf, i, round(avg(close) OVER w, 6) AS sma, round(stddev_pop(close) OVER w, 6) AS sd, round(max(high) OVER w, 6) AS hi, round(100 * (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w), 6) AS k,
  i - max(CASE WHEN close > open THEN i END) OVER (PARTITION BY symbol ORDER BY i) AS since
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) QUALIFY count(*) OVER w = 14""")
def o1_technical(spark, sf_dir):
    from ..functions import technical as K

    at = hourly(spark, sf_dir).select(*KEY, "i", K.sma("close", 14).alias("sma"), K.stdev("close", 14).alias("sd"), K.highest("high", 14).alias("hi"), K.stoch(14).alias("k"), K.bars_since(F.col("close") > F.col("open")).alias("since"))
    return at.where("sma is not null")


_rma = """SELECT symbol, 14 AS i, avg(greatest(d, 0)) AS u, avg(greatest(-d, 0)) AS f FROM steps14_ WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT s.symbol, s.i, (r.u * 13 + greatest(s.d, 0)) / 14, (r.f * 13 + greatest(-s.d, 0)) / 14 FROM rsi_ r JOIN steps14_ s ON s.symbol = r.symbol AND s.i = r.i + 1"""
PARTS |= {"steps14_": "SELECT symbol, i, close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM bars", "rsi_": _rma}
_wma = lambda x, n: "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER w" for k in range(n)) + f") / {n * (n + 1) // 2}.0"


@query(f"""SELECT b.symbol, 60 AS tf, b.i, round(CASE WHEN r.f = 0 THEN 100 ELSE 100 - 100 / (1 + r.u / r.f) END, 6) AS rsi, round(h.hma, 6) AS hma, round(v.close, 6) AS second_rise
FROM bars b LEFT JOIN rsi_ r ON r.symbol = b.symbol AND r.i = b.i
JOIN (SELECT symbol, i, {_wma('raw', 4)} AS hma FROM (SELECT symbol, i, 2 * {_wma('close', 8)} - {_wma('close', 16)} AS raw FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)) WINDOW w AS (PARTITION BY symbol ORDER BY i)) h ON h.symbol = b.symbol AND h.i = b.i
LEFT JOIN (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n FROM bars WHERE close > open) v
  ON v.symbol = b.symbol AND v.n = (SELECT count(*) FROM bars x WHERE x.symbol = b.symbol AND x.i <= b.i AND x.close > x.open) - 1""")
def o2_oscillators(spark, sf_dir):
    from ..functions import technical as K

    at = K.with_hma(K.with_rsi(hourly(spark, sf_dir)), "close", 16, "hma")
    return K.with_value_when(at, F.col("close") > F.col("open"), "close", 1, "second_rise").select(*KEY, "i", "rsi", "hma", "second_rise")


# ---- views at a cursor, zones and features of their own -----------------------------------------------------------


@query("SELECT symbol, tf, kind, i, round(price, 6) AS price, confirmed_i FROM zz150")
def p9_until(spark, sf_dir):
    return P.compress(external(hourly(spark, sf_dir)), 150)


@query("""SELECT symbol, 60 AS tf, kind, i, round(price, 6) AS price, source FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind, i, printf('%.10f', price) ORDER BY source) AS n FROM (
    SELECT symbol, kind, i, price, 'provided' AS source FROM pv3 UNION ALL SELECT symbol, kind, i, price, 'derived' FROM pv9)) WHERE n = 1""")
def p19_deduped(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    both = P.pivots(bars, 3).withColumn("source", F.lit("provided")).unionByName(external(bars).withColumn("source", F.lit("derived")))
    return P.deduped(both).select(*KEY, "kind", "i", "price", "source")


LEAST_ALL = "SELECT symbol, s[floor((len(s) - 1) * 0.7 + 0.5)::INT + 1] AS least FROM (SELECT o.symbol, list_sort(list(z.volume)) AS s FROM obs o JOIN bars z ON z.symbol = o.symbol AND z.i = o.i WHERE z.volume > 0 GROUP BY o.symbol)"


@query(f"""SELECT o.symbol, o.tf, o.scope, o.direction, o.i, o.confirmed_i, z.volume AS zone_volume, l.least, CASE o.direction WHEN 'bear' THEN 'supply' ELSE 'demand' END AS zone
FROM obs o JOIN bars z ON z.symbol = o.symbol AND z.i = o.i LEFT JOIN ({LEAST_ALL}) l ON l.symbol = o.symbol WHERE z.volume >= coalesce(l.least, 0)""")
def t7_lookahead_zones(spark, sf_dir):
    bars = once(spark, sf_dir)
    return T.supply_demand(S.order_blocks(bars, lifted(spark, sf_dir, bars)), bars, causal=False).select(*KEY, "scope", "direction", "i", "confirmed_i", "zone_volume", "least", "zone")


@query(f"""SELECT * FROM (
  SELECT symbol, tf, scope, zone, i, confirmed_i, row_number() OVER (PARTITION BY symbol ORDER BY confirmed_i DESC, i DESC, scope) AS place FROM (
    SELECT o.*, CASE o.direction WHEN 'bear' THEN 'supply' ELSE 'demand' END AS zone FROM obs o JOIN bars z ON z.symbol = o.symbol AND z.i = o.i LEFT JOIN ({LEAST_ALL}) l ON l.symbol = o.symbol
    WHERE z.volume >= coalesce(l.least, 0) AND o.confirmed_i <= 404) k
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = k.symbol AND b.i > k.confirmed_i AND b.i <= 404 AND CASE k.zone WHEN 'demand' THEN b.low <= k.top ELSE b.high >= k.bottom END)) WHERE place <= 15""")
def t9_untouched_zones(spark, sf_dir):
    bars = once(spark, sf_dir)
    zones = T.supply_demand(S.order_blocks(bars, lifted(spark, sf_dir, bars)), bars, causal=False)
    return T.untouched(zones, bars, 404).select(*KEY, "scope", "zone", "i", "confirmed_i", "place")


@query("""SELECT e.symbol, 60 AS tf, e.direction, r.ratio, round(CASE e.direction WHEN 'bull' THEN max(b.high) - (max(b.high) - min(b.low)) * r.ratio ELSE min(b.low) + (max(b.high) - min(b.low)) * r.ratio END, 6) AS price
FROM (SELECT symbol, m.pivot_i, m.i, m.direction FROM (SELECT symbol, arg_max({'pivot_i': pivot_i, 'i': i, 'direction': direction}, (scope = 'external', i)) AS m FROM broken GROUP BY symbol)) e
JOIN bars b ON b.symbol = e.symbol AND b.i BETWEEN e.pivot_i AND e.i CROSS JOIN unnest([0.0::DOUBLE, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]) r(ratio) GROUP BY e.symbol, e.direction, r.ratio""")
def z3_structure_fib(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return Z.structure_fibonacci(breaks(bars), bars)


@query("""SELECT symbol, 60 AS tf, ratio, round(b - (b - a) * ratio, 6) AS price FROM (SELECT symbol, arg_min(open, i) AS a, arg_max(close, i) AS b FROM bars GROUP BY symbol)
CROSS JOIN unnest([0.0::DOUBLE, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.414, 1.618]) r(ratio)""")
def z4_manual_fib(spark, sf_dir):
    spans = hourly(spark, sf_dir).groupBy(*KEY).agg(F.min_by("open", "i").alias("from_price"), F.max_by("close", "i").alias("to_price"))
    return Z.manual_fibonacci(spans).select(*KEY, "ratio", "price")


@query("""SELECT symbol, 60 AS tf, CASE WHEN first THEN h.i ELSE l.i END AS latest_i, round(CASE WHEN first THEN h.p ELSE l.p END, 6) AS latest_price, CASE WHEN first THEN l.i ELSE h.i END AS opposite_i, round(CASE WHEN first THEN l.p ELSE h.p END, 6) AS opposite_price FROM (
  SELECT *, coalesce(h.i >= l.i, h IS NOT NULL) AS first FROM (
    SELECT symbol, arg_max({'i': i, 'p': price}, i) FILTER (kind = 'high') AS h, arg_max({'i': i, 'p': price}, i) FILTER (kind = 'low') AS l FROM pv3 WHERE confirmed_i <= 150 GROUP BY symbol))""")
def f7_alternating(spark, sf_dir):
    out = X.alternating(P.pivots(hourly(spark, sf_dir), 3), 150)
    return out.select(*KEY, *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("latest", "opposite") for x in ("i", "price")])


def sr_sql(hours: int) -> str:
    return f"""SELECT symbol, 60 AS tf, g, available_i, round(h, 6) AS resistance, round(l, 6) AS support FROM (
  SELECT symbol, g, available_i, lag(hi) OVER w AS h, lag(lo) OVER w AS l FROM (SELECT symbol, time // {hours * 3600} AS g, min(i) AS available_i, max(high) AS hi, min(low) AS lo FROM bars GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY g)) WHERE h IS NOT NULL"""


@query(sr_sql(24))
def f9_support_resistance_day(spark, sf_dir):
    return Z.support_resistance(hourly(spark, sf_dir), 24)


@query(sr_sql(168))
def f9_support_resistance_week(spark, sf_dir):
    return Z.support_resistance(hourly(spark, sf_dir), 168)


@query("""SELECT b.symbol, b.tf, b.i, coalesce(max(e.i), 0) AS segment FROM bars b LEFT JOIN (SELECT DISTINCT symbol, i FROM broken WHERE scope = 'external') e ON e.symbol = b.symbol AND e.i <= b.i
WHERE b.symbol IN (SELECT symbol FROM broken WHERE scope = 'external') GROUP BY b.symbol, b.tf, b.i""")
def a1_event_segments(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return A.event_segments(bars, breaks(bars)).select(*KEY, "i", "segment")


@query("SELECT symbol, tf, i, greatest(n - 499, 0) AS segment FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM bars) WHERE i >= n - 499")
def a1_contingency_segment(spark, sf_dir):
    return A.contingency_segment(hourly(spark, sf_dir)).select(*KEY, "i", "segment")


@query("""SELECT symbol, tf, from_i, round(from_price, 6) AS from_price, i AS to_i, round(price, 6) AS to_price, confirmed_i, CASE WHEN price >= from_price THEN 'bull' ELSE 'bear' END AS direction, active FROM (
  SELECT symbol, tf, i, price, confirmed_i, lag(i) OVER w AS from_i, lag(price) OVER w AS from_price, false AS active FROM zz150 WINDOW w AS (PARTITION BY symbol ORDER BY i)
  UNION ALL
  SELECT b.symbol, 60, CASE z.kind WHEN 'high' THEN arg_max(b.i, (-b.low, b.i)) ELSE arg_max(b.i, (b.high, b.i)) END, CASE z.kind WHEN 'high' THEN min(b.low) ELSE max(b.high) END, NULL, z.i, z.price, true
  FROM bars b JOIN (SELECT symbol, arg_max(kind, i) AS kind, arg_max(price, i) AS price, max(i) AS i FROM zz150 GROUP BY symbol) z ON z.symbol = b.symbol WHERE b.i > z.i AND b.i <= 150 GROUP BY b.symbol, z.kind, z.i, z.price)
WHERE from_i IS NOT NULL AND from_i <> i""")
def p13_closed_and_active(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return P.closed_and_active(P.compress(external(bars), 150), bars, 150)


@query("""SELECT p.symbol, m.tf, p.kind, m.i, m.time, round(p.price, 6) AS price, e.last AS confirmed_i
FROM pv3 p JOIN (SELECT symbol, time // 3600 * 3600 AS h, arg_min(i, (-high, i)) AS hi, arg_min(i, (low, i)) AS li FROM minutes GROUP BY ALL) x ON x.symbol = p.symbol AND x.h = p.time
JOIN bars c ON c.symbol = p.symbol AND c.i = p.confirmed_i JOIN (SELECT symbol, time // 3600 * 3600 AS h, max(i) AS last FROM minutes GROUP BY ALL) e ON e.symbol = p.symbol AND e.h = c.time
JOIN minutes m ON m.symbol = p.symbol AND m.i = CASE p.kind WHEN 'high' THEN x.hi ELSE x.li END""")
def p4_pivots_at_resolution(spark, sf_dir):
    fine = minutes(spark, sf_dir)
    return P.at_resolution(fine, B.resample_extremes(fine, 60), 3)


@query("""SELECT symbol, tf, event_time, "Y_5m" AS "actual_Y_5m", p AS "prediction_Y_5m", "Y_5m" - p AS "residual_Y_5m" FROM (
  SELECT symbol, 60 AS tf, time AS event_time, volume::BIGINT AS "Y_5m", coalesce(lag(volume) OVER (PARTITION BY symbol ORDER BY i), 0)::BIGINT AS p FROM bars)""")
def s10_prediction_rows(spark, sf_dir):
    from ..operators.core import along
    from ..sources.candles import predictions

    bars = hourly(spark, sf_dir).withColumn("event_time", F.col("time")).withColumn("Y_5m", F.col("volume").cast("long"))
    return predictions(bars.withColumn("p", F.coalesce(F.lag("Y_5m").over(along()), F.lit(0).cast("long"))), ["Y_5m"], ["p"], [*KEY, "event_time"])


@query()
def n3_train_evaluate(spark, sf_dir):
    """Metrics of held-out predictions of the counts of ghost events, from the features of the bar where each appears."""
    from ..operators import training as R

    bars = once(spark, sf_dir)
    events = X.labels(P.ghost_trace(bars, 5), bars, (180, 300, 600, 900)).where("complete")
    measured_ = V.regime_features(V.average_true_range(bars), F.col("atr")).select(*KEY, F.col("i").alias("event_i"), *M.FEATURES)
    targets = [f"Y_{n}m" for n in (180, 300, 600, 900)]
    _, told, _ = R.evaluated(events.join(measured_, [*KEY, "event_i"]), M.FEATURES, targets, length=4, limits=(3, 5, 10, 15), hidden=8, batches=2, epochs=4)
    return told


# ---- views at every cursor ----------------------------------------------------------------------------------------


PREFIXES = f"(SELECT b.symbol, b.i, b.open, b.high, b.low, b.close, b.volume, {{'f': c.segment, 't': c.i}} AS segment FROM {DAYS} c JOIN {DAYS} b ON b.symbol = c.symbol AND b.segment = c.segment AND b.i <= c.i)"

#: bins_ and area_ of all prefixes. Prices are whole billionths, and parts are rounded half up to whole billionths of a tick
#: and summed as such: bins equally full are equal in any order of the sums and at any volume. An area may lack half a
#: billionth a part of its share.
EXACT_PARTS = {
    "bins_": f"""SELECT e.symbol, e.segment, g.bin, e.lo, e.step,
               coalesce(sum(floor(CASE WHEN d.h > d.l THEN volume * (least((g.bin + 1) * (e.h - e.l), (d.h - e.l) * 24) - greatest(g.bin * (e.h - e.l), (d.l - e.l) * 24)) / ((d.h - d.l) * 24) ELSE volume END * 1e9 + 0.5)::HUGEINT), 0)::HUGEINT AS v
        FROM edges_ e CROSS JOIN range(24) g(bin) LEFT JOIN (SELECT symbol, segment, volume, floor(low * 1e9 + 0.5)::BIGINT AS l, floor(high * 1e9 + 0.5)::BIGINT AS h FROM {PREFIXES} WHERE volume > 0) d
          ON d.symbol = e.symbol AND d.segment = e.segment AND g.bin BETWEEN CASE WHEN e.h > e.l THEN least((d.l - e.l) * 24 // (e.h - e.l), 23) ELSE 12 END AND CASE WHEN e.h > e.l THEN least((d.h - e.l) * 24 // (e.h - e.l), 23) ELSE 12 END
        GROUP BY ALL""",
    "area_": f"""SELECT symbol, segment, lo, step, list(v ORDER BY bin) AS v, arg_min(bin, (-v, bin)) AS poc, arg_min(bin, (-v, bin)) AS a, arg_min(bin, (-v, bin)) AS b, max(v) AS held, total, parts, 0 AS k
        FROM bins_ JOIN (SELECT symbol, segment, sum(volume) AS total, count(*) * 24 AS parts FROM {PREFIXES} WHERE volume > 0 GROUP BY ALL) USING (symbol, segment) GROUP BY symbol, segment, lo, step, total, parts
        UNION ALL
        SELECT symbol, segment, lo, step, v, poc, CASE WHEN up >= down THEN a ELSE a - 1 END, CASE WHEN up >= down THEN b + 1 ELSE b END, held + greatest(up, down), total, parts, k + 1
        FROM (SELECT *, CASE WHEN b < 23 THEN v[b + 2] ELSE -1 END AS up, CASE WHEN a > 0 THEN v[a] ELSE -1 END AS down FROM area_) WHERE held * 10 + parts * 5 < floor(total * 1e9 + 0.5)::HUGEINT * 7 AND greatest(up, down) >= 0""",
}
PARTS["edges_"] = f"""SELECT symbol, segment, lo, (hi - lo) / 24 AS step, l, h FROM (
          SELECT symbol, segment, CASE WHEN x.h > x.l THEN x.l ELSE x.l - greatest(abs(x.l) * 1e-9, 1e-9) / 2 END AS lo, CASE WHEN x.h > x.l THEN x.h ELSE x.h + greatest(abs(x.l) * 1e-9, 1e-9) / 2 END AS hi,
                 floor(x.l * 1e9 + 0.5)::BIGINT AS l, floor(x.h * 1e9 + 0.5)::BIGINT AS h
          FROM (SELECT symbol, segment, min(low) AS l, max(high) AS h FROM {PREFIXES} GROUP BY ALL) x)"""


@query()
def a5_profiles_at(spark, sf_dir):
    return W.profiles_at(A.session_segments(hourly(spark, sf_dir)))


ORACLE["a5_profiles_at"] = with_parts(
    f"""SELECT v.symbol, 60 AS tf, v.segment.f AS segment, v.segment.t AS cursor, round(v.total, 6) AS total, round(lo + (poc + 0.5) * step, 6) AS poc, round(lo + (b + 1) * step, 6) AS vah, round(lo + a * step, 6) AS val, v.segment.t < e.e AS truncated
    FROM value_ v JOIN (SELECT symbol, segment, max(i) AS e FROM {DAYS} GROUP BY ALL) e ON e.symbol = v.symbol AND e.segment = v.segment.f""",
    EXACT_PARTS,
)


@query()
def a10_missed_line(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return W.missed_lines(bars, P.missed_pivots(bars, 5)).select(*KEY, "cursor", "anchor_i", "pivot_type", "confirmed_i", (F.col("vwap") + 3e-8).alias("vwap"), "sigma")


#: Lines (symbol, cursor, a, and any more) with VWAP and deviation at the cursor.
ENDS = """SELECT l.*, round(m.vwap + 3e-8, 6) AS vwap, round(sqrt(greatest(m.q, 0)), 6) AS sigma FROM lines_ l JOIN (
  SELECT s.symbol, s.a, s.cursor, s.vwap, sum(b.volume * ((b.high + b.low + b.close) / 3 - s.vwap) ** 2) / sum(b.volume) AS q FROM (
    SELECT d.symbol, d.a, d.cursor, sum(b.volume * (b.high + b.low + b.close) / 3) / sum(b.volume) AS vwap FROM (SELECT DISTINCT symbol, a, cursor FROM lines_) d JOIN bars b ON b.symbol = d.symbol AND b.i BETWEEN d.a AND d.cursor GROUP BY ALL) s
  JOIN bars b ON b.symbol = s.symbol AND b.i BETWEEN s.a AND s.cursor GROUP BY ALL) m ON m.symbol = l.symbol AND m.a = l.a AND m.cursor = l.cursor"""
PARTS["ghost_now_"] = """SELECT b.symbol, b.i AS cursor, s.known, s.anchor, s.kind,
         (SELECT max((CASE WHEN s.kind = 'high' THEN -x.low ELSE x.high END, x.i)) FROM bars x WHERE x.symbol = b.symbol AND x.i > s.anchor AND x.i <= b.i)[2] AS ghost
  FROM bars b ASOF JOIN (
    SELECT symbol, known, arg_max(anchor, kind = 'low') AS anchor, arg_max(kind, kind = 'low') AS kind FROM (SELECT symbol, confirmed_i AS known, i AS anchor, kind FROM tied) GROUP BY symbol, known
    UNION ALL SELECT DISTINCT symbol, 0, 0, 'initial' FROM bars) s ON s.symbol = b.symbol AND b.i >= s.known"""
PARTS["lines_"] = """SELECT symbol, cursor, 'ghost_regular_pivot' AS source, kind AS pivot_type, anchor AS a, known AS confirmed_i FROM ghost_now_ WHERE kind <> 'initial'
  UNION ALL SELECT symbol, cursor, 'ghost_live', CASE kind WHEN 'high' THEN 'low' ELSE 'high' END, ghost, NULL FROM ghost_now_ WHERE ghost IS NOT NULL"""


@query(f"SELECT symbol, 60 AS tf, cursor, source, pivot_type, a AS anchor_i, confirmed_i, vwap, sigma FROM ({ENDS})")
def a11_ghost_lines(spark, sf_dir):
    return W.ghost_lines(hourly(spark, sf_dir), 5).select(*KEY, "cursor", "source", "pivot_type", "anchor_i", "confirmed_i", (F.col("vwap") + 3e-8).alias("vwap"), "sigma")


@query()
def a13_lines_at(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    found = W.known_anchors(bars, breaks(bars))
    return W.lines_at(bars, found, bars.select(*KEY, F.col("i").alias("cursor"))).withColumn("vwap", F.col("vwap") + 3e-8)


ORACLE["a13_lines_at"] = with_parts(
    f"SELECT symbol, 60 AS tf, shown AS cursor, a AS anchor_i, cursor AS end_i, vwap, sigma FROM ({ENDS})",
    {
        "lines_": """SELECT c.symbol, c.i AS shown, k.i AS a, coalesce(lead(k.i) OVER (PARTITION BY c.symbol, c.i ORDER BY k.i) - 1, c.i) AS cursor FROM bars c JOIN (
          SELECT symbol, i, min(known) AS known FROM (
            SELECT symbol, min(i) AS i, min(i) AS known FROM bars GROUP BY symbol, time // 86400
            UNION ALL SELECT symbol, coalesce(open_, first_), coalesce(open_, lead(first_) OVER (PARTITION BY symbol ORDER BY day)) FROM (SELECT symbol, time // 86400 AS day, min(i) AS first_, min(i) FILTER (time % 86400 >= 34200) AS open_ FROM bars GROUP BY ALL)
            UNION ALL SELECT symbol, i, i FROM broken) WHERE known IS NOT NULL GROUP BY symbol, i) k ON k.symbol = c.symbol AND k.known <= c.i"""
    },
)


def structure_items(bars: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    inner, outer, events = P.pivots(bars, 3), external(bars), breaks(bars)
    known = lambda df, c: df.withColumn("known_i", F.col(c))
    items = {f"{name}_{kind}": known(found.where(F.col("kind") == kind), "confirmed_i") for name, found in (("swing", inner), ("external", outer)) for kind in ("high", "low")}
    items |= {kind.lower(): known(events.where(F.col("type") == kind), "i") for kind in ("BOS", "CHOCH")}
    items |= {"fvg": known(S.lifecycle(bars, S.gaps(bars)), "confirmed_i"), "order_block": known(S.lifecycle(bars, S.order_blocks(bars, events)), "confirmed_i")}
    return items | {"trendline": known(S.trendlines(inner, bars).withColumnRenamed("break_i", "end_i"), "confirmed_i")}, events, outer


_counts = {f"n_{name}_{kind}": f"SELECT count(*) FROM {part} x WHERE x.symbol = b.symbol AND x.kind = '{kind}' AND x.confirmed_i <= b.i" for name, part in (("swing", "pv3"), ("external", "pv9")) for kind in ("high", "low")}
_counts |= {f"n_{kind.lower()}": f"SELECT count(*) FROM broken x WHERE x.symbol = b.symbol AND x.type = '{kind}' AND x.i <= b.i" for kind in ("BOS", "CHOCH")}
for _name, _rows in (("fvg", "(SELECT * FROM zones_ WHERE what = 'fvg')"), ("order_block", "(SELECT * FROM zones_ WHERE what = 'ob')"), ("trendline", f"(SELECT *, break_i AS end_i FROM ({ORACLE['m9_trendlines'][ORACLE['m9_trendlines'].index('SELECT l.symbol, 60 AS tf, l.direction'):]}))")):
    _counts[f"n_{_name}"] = f"SELECT count(*) FROM {_rows} x WHERE x.symbol = b.symbol AND x.confirmed_i <= b.i"
    _counts[f"open_{_name}"] = f"SELECT count(*) FROM {_rows} x WHERE x.symbol = b.symbol AND x.confirmed_i <= b.i AND (x.end_i IS NULL OR x.end_i > b.i)"


@query(f"""SELECT symbol, tf, cursor, {', '.join(_counts)}, w.type AS last_type, w.scope AS last_scope, w.direction AS last_direction, round(w.level, 6) AS last_level, round(h, 6) AS major_high, round(l, 6) AS major_low, round((h + l) / 2, 6) AS equilibrium FROM (
  SELECT b.symbol, 60 AS tf, b.i AS cursor, {', '.join(f'({v}) AS {k}' for k, v in _counts.items())},
         (SELECT arg_max({{'type': type, 'scope': scope, 'direction': direction, 'level': level}}, (i, scope = 'external', direction = 'bear')) FROM broken x WHERE x.symbol = b.symbol AND x.i <= b.i) AS w,
         (SELECT arg_max(price, i) FROM pv9 x WHERE x.symbol = b.symbol AND x.kind = 'high' AND x.confirmed_i <= b.i) AS h, (SELECT arg_max(price, i) FROM pv9 x WHERE x.symbol = b.symbol AND x.kind = 'low' AND x.confirmed_i <= b.i) AS l
  FROM bars b)""")
def m11_snapshot(spark, sf_dir):
    bars = once(spark, sf_dir)
    return W.structure_at(bars, *structure_items(bars))
