"""Sequence models trained where the data are: gradients of each partition, summed by the engine.

The weights, and what Adam keeps of them, are on the driver; their size is that
of the model, whatever the data. A step sends them to the partitions of one
batch, each of which returns the sum of its rows' gradients as (place, value)
rows; these are added by place, so what comes back is one number for a weight.
No row of the data leaves its partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from .core import KEY
from .learning import Lstm
from .scratch import kept

PART = "place int, value double"


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _arrays(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array([np.stack(list(s)) for s in batch["sequence"]], dtype=float), np.stack([np.asarray(t, dtype=float) for t in batch["target"]])


def gradient(rows: DataFrame, model: Lstm) -> tuple[int, float, dict[str, np.ndarray] | None]:
    """Rows, mean squared error and its gradient over all rows (sequence, target); the gradient is None without rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, loss = None, 0, 0.0
        for batch in batches:
            for at in range(0, len(batch), 512):
                x, y = _arrays(batch.iloc[at : at + 512])
                error, g = model.gradients(x, y)
                g = flat(g) * len(x)
                total = g if total is None else total + g
                n, loss = n + len(x), loss + error * len(x)
        if n:
            yield pd.DataFrame({"place": np.arange(-2, len(total), dtype="int32"), "value": np.concatenate([[n, loss], total])})

    sums = rows.select("sequence", "target").mapInPandas(run, PART).groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
    if not len(sums):
        return 0, 0.0, None
    n = int(sums[0])
    return n, float(sums[1] / n), shaped(sums[2:] / n, model.p)


class Adam:
    """Steps of Adam with gradients clipped by their norm."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 1e-3, clip: float = 5.0):
        self.rate, self.clip, self.t = rate, clip, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum((a**2).sum() for a in g.values()))
        self.t += 1
        for k, a in g.items():
            a = a * min(1.0, self.clip / max(norm, 1e-12))
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * a, 0.999 * self.v[k] + 0.001 * a * a
            p[k] = p[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def fit(train: DataFrame, held: DataFrame, inputs: int, outputs: int, *, hidden: int = 32, batches: int = 8, epochs: int = 30, rate: float = 1e-3, clip: float = 5.0, patience: int = 6, seed: int = 42, order: str = "row") -> tuple[Lstm, dict]:
    """A model of train's rows (sequence, target and a unique `order`), stopped when held's loss has not improved for `patience` epochs.

    A row's batch is a hash of its `order` and the epoch, so reruns see the same batches. Without rows the model is untrained.
    """
    model = Lstm(inputs, hidden, outputs, seed)
    adam, losses, best = Adam(model.p, rate, clip), [], (np.inf, 0, None)
    train, held = kept(train.select(order, "sequence", "target"), "train"), kept(held.select("sequence", "target"), "held")
    for epoch in range(1, epochs + 1):
        for batch in range(batches):
            chosen = train.where(F.pmod(F.xxhash64(F.col(order), F.lit(epoch), F.lit(seed)), F.lit(batches)) == batch)
            n, _, g = gradient(chosen, model)
            if n:
                adam.step(model.p, g)
        n, loss, _ = gradient(held, model)
        losses.append(loss if n else 0.0)
        if losses[-1] < best[0]:
            best = (losses[-1], epoch, {k: a.copy() for k, a in model.p.items()})
        elif epoch - best[1] >= patience:
            break
    model.p = best[2] or model.p
    return model, {"best_epoch": best[1], "losses": losses}


def predict(rows: DataFrame, model: Lstm, to: Sequence[str]) -> DataFrame:
    """rows with one column of `to` for each output of the model."""
    names = [*rows.columns, *to]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                out = model.predict(np.array([np.stack(list(s)) for s in part["sequence"]], dtype=float))
                yield pd.concat([part.reset_index(drop=True), pd.DataFrame(out, columns=list(to))], axis=1)[names]

    kinds = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{c}` double" for c in to])
    return rows.mapInPandas(run, kinds)


def evaluated(rows: DataFrame, numeric: Sequence[str], targets: Sequence[str], *, order: str = "event_time", length: int = 16, limits: Sequence[int] = X.HORIZONS, **settings) -> tuple[DataFrame, DataFrame, dict]:
    """From event rows to held-out predictions and their metrics, without a look ahead.

    Rows are split by time with a purge; medians, means and deviations come from
    the training part; sequences of `length` events end at their row. Returns
    the validation rows with prediction columns p_<target> (counts, constrained),
    metrics by target, and the report of the training.
    """
    rows = kept(X.temporal_split(rows, order).select(*KEY, order, "part", *[F.col(c).cast("double").alias(c) for c in numeric], *targets), "rows")
    train = rows.where("part = 'train'")
    inputs = [f"{c}_z" for c in numeric]
    scaled = X.scale(rows, kept(X.fit_scaler(train, numeric), "scaler"), numeric)
    centre = train.agg(*[F.avg(c).alias(f"m_{c}") for c in targets], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in targets]).first()
    told = X.sequences(scaled, inputs, order, length).withColumn("row", F.xxhash64(*KEY, order))
    told = kept(told.withColumn("target", F.array(*[(F.col(c) - F.lit(float(centre[f"m_{c}"] or 0.0))) / F.lit(float(centre[f"s_{c}"])) for c in targets])), "sequences")
    model, report = fit(told.where("part = 'train'"), told.where("part = 'validation'"), len(inputs), len(targets), **settings)
    raw = [f"p_{c}" for c in targets]
    out = predict(told.where("part = 'validation'").select(*KEY, order, "sequence", *targets), model, raw).drop("sequence")
    out = out.withColumns({f"p_{c}": F.col(f"p_{c}") * float(centre[f"s_{c}"]) + float(centre[f"m_{c}"] or 0.0) for c in targets})
    out = kept(X.constrained(out, raw, limits), "predictions")
    each = [X.metrics(out, c, f"p_{c}").select(F.lit(c).alias("target"), "*") for c in targets]
    told_all = each[0]
    for more in each[1:]:
        told_all = told_all.unionByName(more)
    return out, told_all, report
