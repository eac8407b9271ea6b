"""Rule-based market regime: a state for each bar from liquidity, structure and the state before."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import KEY, fold
from .liquidity import nearest
from .series import volume_average

SCHEMA = "i int, time long, state string, confidence double"
TREND = ("TR_BULLISH", "TR_BEARISH")


def regime(bars: DataFrame, found: DataFrame, events: DataFrame) -> DataFrame:
    """bars need column atr; found are levels, events structure breaks of both scopes.

    All that a bar needs but the state before is joined first; the rest is an
    automaton of eight states.
    """
    near = nearest(bars, found)
    raid = F.col("classification").isin("SWEEP", "GRAB", "BIG_GRAB")
    outer = (F.col("scope") == "external") & (F.col("scope_confirmed_i") <= F.col("resolved_i"))
    any_ = lambda c: F.max(c.cast("int"))
    liquid = found.where("resolved_i is not null").groupBy(*KEY, F.col("resolved_i").alias("i")).agg(any_(raid & outer).alias("raid_out"), any_(raid & ~outer).alias("raid_in"), any_((F.col("classification") == "RUN") & outer).alias("run_out"), F.count(F.lit(1)).alias("n_liquid"))
    big = F.col("scope") == "external"
    # of several external breaks of a bar the bull comes first, as the fold finds it first
    breaks = events.groupBy(*KEY, "i").agg(F.max(F.when(big & (F.col("type") == "BOS"), F.when(F.col("direction") == "bull", 2).otherwise(1))).alias("bos_out"), any_(big & (F.col("type") == "CHOCH")).alias("choch_out"), F.count(F.lit(1)).alias("n_breaks"))
    first = found.groupBy(*KEY).agg(F.min("confirmed_i").alias("first_known"))
    at = volume_average(bars).join(near, [*KEY, "i"], "left").join(liquid, [*KEY, "i"], "left").join(breaks, [*KEY, "i"], "left").join(first, KEY, "left")
    has_atr = F.coalesce(F.col("atr") > 0, F.lit(False))
    base = F.when(~has_atr, "UNKNOWN").when(F.col("external_i").isNotNull(), "LIQUIDEZ_EXTERNA").when(F.col("internal_i").isNotNull(), "LIQUIDEZ_INTERNA").when(F.col("first_known") <= F.col("i"), "ZONA_INTERNA").otherwise("UNKNOWN")
    score = F.when(~has_atr, 0.30).when(F.col("external_i").isNotNull(), 0.60).when(F.col("internal_i").isNotNull(), 0.52).when(F.col("first_known") <= F.col("i"), 0.45).otherwise(0.35)
    flags = ("raid_out", "raid_in", "run_out", "n_liquid", "bos_out", "choch_out", "n_breaks")
    rows = at.select(*KEY, "i", "time", base.alias("base"), score.alias("score"), F.when(F.col("high_volume"), 0.05).otherwise(0.0).alias("bonus"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in flags])

    def kernel(b: dict[str, np.ndarray]) -> dict:
        states, scores, before = [], [], "UNKNOWN"
        for i in range(len(b["i"])):
            state, more = b["base"][i], 0.0
            bos, choch = b["bos_out"][i], b["choch_out"][i]
            if b["raid_out"][i] and choch:
                state, more = "TRANSITION", 0.30
            elif bos:
                state, more = TREND[0 if bos == 2 else 1], 0.35 if b["run_out"][i] else 0.25
            elif choch:
                state, more = "TRANSITION", 0.20
            elif b["raid_in"][i]:
                state, more = "ZM_MANIPULATION", 0.10
            elif before == "TRANSITION" and state in ("ZONA_INTERNA", "LIQUIDEZ_INTERNA"):
                state, more = "ZM_MANIPULATION", -0.05
            elif before in TREND and not b["n_liquid"][i] and not b["n_breaks"][i]:
                state, more = before, 0.05
            states.append(state)
            scores.append(round(min(1.0, max(0.0, b["score"][i] + more + b["bonus"][i])), 2))
            before = state
        return {"i": b["i"], "time": b["time"], "state": states, "confidence": scores}

    return fold(rows, kernel, SCHEMA)
