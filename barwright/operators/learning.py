"""Regime models: deterministic k-means, diagonal Gaussian mixture, hidden Markov chain, and the LSTM.

Models are small and fitted from bounded training rows of one series; applying
them is a DataFrame expression (k-means) or an Arrow batch function.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import KEY, fold

FEATURES = ("return_1", "trend_return", "volatility", "atr_pct", "volume_ratio")


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations (1 where there is none)."""
    variance = x.var(axis=0)
    return x.mean(axis=0), np.where(variance > 1e-24, np.sqrt(variance), 1.0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Row 0, then again and again the row farthest from those chosen (the first on ties)."""
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(distances(x, x[chosen]).min(axis=1).argmax()))
    return x[chosen].copy()


def states_of(centres: np.ndarray, volatility: int = 2, trend: int = 1) -> list[str]:
    """Names of clusters: the most volatile, the strongest trend of the rest, and ranging."""
    names = ["RANGING"] * len(centres)
    top = int(centres[:, volatility].argmax())
    names[top] = "VOLATILE"
    rest = [k for k in range(len(centres)) if k != top]
    if rest:
        strong = max(rest, key=lambda k: abs(centres[k, trend]))
        names[strong] = "TREND_BULLISH" if centres[strong, trend] >= 0 else "TREND_BEARISH"
    return names


def distinct_rows(x: np.ndarray) -> int:
    return len({tuple(f"{v:.15g}" for v in row) for row in x})


@dataclass
class KMeans:
    means: list[float]
    scales: list[float]
    centres: list[list[float]]
    states: list[str]
    trained_through: int
    columns: list[str] = field(default_factory=lambda: list(FEATURES))

    @classmethod
    def fit(cls, x: np.ndarray, k: int = 3, rounds: int = 50, trained_through: int = -1, min_samples: int = 30) -> KMeans | None:
        """None if there are too few rows or distinct rows, or a cluster is empty."""
        if len(x) < max(min_samples, 1):
            return None
        mean, scale = standardise(x)
        z = (x - mean) / scale
        if distinct_rows(z) < k:
            return None
        centres, own = farthest_first(z, k), np.zeros(len(z), int)
        for _ in range(rounds):
            now = distances(z, centres).argmin(axis=1)
            changed, own = bool((now != own).any()), now
            for c in range(k):
                if (own == c).any():
                    centres[c] = z[own == c].mean(axis=0)
            if not changed:
                break
        if len(set(own.tolist())) < k:
            return None
        raw = centres * scale + mean
        return cls(mean.tolist(), scale.tolist(), centres.tolist(), states_of(raw), trained_through)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows after training with cluster, state, distance and confidence: expressions only."""
        z = [(F.col(c) - m) / s for c, m, s in zip(self.columns, self.means, self.scales, strict=True)]
        square = [sum(((a - float(v)) * (a - float(v)) for a, v in zip(z, centre, strict=True)), F.lit(0.0)) for centre in self.centres]
        best = F.least(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(square)]) if len(square) > 1 else F.struct(square[0].alias("d"), F.lit(0).alias("k"))
        at = rows.where(F.col("available") & (F.col("i") > self.trained_through)).withColumn("__b", best)
        return at.select(*KEY, "i", "time", F.col("__b.k").alias("cluster"), F.element_at(F.array(*map(F.lit, self.states)), F.col("__b.k") + 1).alias("state"), F.sqrt("__b.d").alias("distance"), (1 / (1 + F.sqrt("__b.d"))).alias("confidence"))


def training_rows(features: DataFrame, end: int, columns=FEATURES, most: int = 200_000) -> np.ndarray:
    """Feature rows of one series up to bar `end`, in order; more than `most` is an error rather than a sample."""
    rows = features.where(F.col("available") & (F.col("i") <= end)).orderBy("i").select(*columns).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} training rows; give an earlier end")
    return rows.to_numpy(float)


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class GaussianMixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float
    rounds: int
    converged: bool

    @classmethod
    def fit(cls, x: np.ndarray, k: int = 3, *, most: int = 100, tolerance: float = 1e-6, floor: float = 1e-6) -> GaussianMixture:
        """Expectation maximisation with diagonal covariances from farthest-first means; a dead component moves to the worst-explained row."""
        if x.ndim != 2 or not np.isfinite(x).all():
            raise ValueError("rows must be finite and of equal length")
        if distinct_rows(x) < k:
            raise ValueError("fewer distinct rows than components")
        spread = np.maximum(x.var(axis=0), floor)
        model = cls(np.full(k, 1 / k), farthest_first(x, k), np.tile(spread, (k, 1)), -np.inf, 0, False)
        for r in range(1, most + 1):
            joint = model.joint(x)
            total = log_sum_exp(joint)
            share = np.exp(joint - total[:, None])
            mass = share.sum(axis=0)
            for c in range(k):
                if mass[c] <= 1e-12:
                    model.means[c], model.variances[c], model.weights[c] = x[int(total.argmin())], spread, 1 / len(x)
                    continue
                model.weights[c] = mass[c] / len(x)
                model.means[c] = share[:, c] @ x / mass[c]
                model.variances[c] = np.maximum(share[:, c] @ (x - model.means[c]) ** 2 / mass[c], floor)
            model.weights /= model.weights.sum()
            likelihood = float(total.sum())
            model.rounds, model.converged = r, abs(likelihood - model.log_likelihood) <= tolerance
            model.log_likelihood = likelihood
            if model.converged:
                break
        return model

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        d = (x[:, None, :] - self.means[None]) ** 2 / self.variances[None]
        return -0.5 * (d + np.log(2 * np.pi * self.variances)[None]).sum(axis=2)

    def joint(self, x: np.ndarray) -> np.ndarray:
        return self.log_densities(x) + np.log(self.weights)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        joint = self.joint(x)
        return np.exp(joint - log_sum_exp(joint)[:, None])

    def diagnostics(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.probabilities(x)
        return {"component": p.argmax(axis=1), "confidence": p.max(axis=1), "entropy": -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1), "log_density": log_sum_exp(self.joint(x))}

    def save(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()})

    @classmethod
    def load(cls, text: str) -> GaussianMixture:
        v = json.loads(text)
        arrays = {k: np.array(v[k], float) for k in ("weights", "means", "variances")}
        k = len(arrays["weights"])
        if arrays["means"].shape != arrays["variances"].shape or len(arrays["means"]) != k or abs(arrays["weights"].sum() - 1) > 1e-6 or (arrays["variances"] <= 0).any():
            raise ValueError("not a valid mixture")
        return cls(**(v | arrays))


@dataclass
class MarkovChain:
    """Hidden states with their first and step probabilities; emissions are log probabilities of each row and state."""

    states: list[str]
    first: np.ndarray
    step: np.ndarray

    @staticmethod
    def estimate(path: np.ndarray, k: int, smooth: float = 1.0, sticky: float = 0.05) -> np.ndarray:
        counts = np.full((k, k), smooth)
        np.add.at(counts, (path[:-1], path[1:]), 1)
        rows = counts / counts.sum(axis=1, keepdims=True)
        rows = (1 - sticky) * rows + sticky * np.eye(k)
        return rows / rows.sum(axis=1, keepdims=True)

    @staticmethod
    def initial(path: np.ndarray, k: int, smooth: float = 1.0) -> np.ndarray:
        counts = np.bincount(path[:1], minlength=k) + smooth
        return counts / counts.sum()

    def forward(self, emissions: np.ndarray) -> np.ndarray:
        """Filtered probabilities: row t uses rows 0..t only."""
        out, belief = np.empty_like(emissions), None
        for t, e in enumerate(emissions):
            belief = self.forward_step(belief, e)
            out[t] = belief
        return out

    def forward_step(self, belief: np.ndarray | None, emission: np.ndarray) -> np.ndarray:
        prior = self.first if belief is None else belief @ self.step
        x = np.log(np.maximum(prior, 1e-300)) + emission
        return np.exp(x - log_sum_exp(x))

    def viterbi(self, emissions: np.ndarray) -> list[int]:
        """The likeliest path in hindsight (it looks ahead)."""
        best, back = np.log(np.maximum(self.first, 1e-300)) + emissions[0], []
        for e in emissions[1:]:
            ways = best[:, None] + np.log(np.maximum(self.step, 1e-300))
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    @staticmethod
    def discrete(symbols: list[int], matrix: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(matrix[:, symbols].T, 1e-300))


REGIME_SCHEMA = "i int, time long, state string, confidence double, trained_through int"


def regimes(features: DataFrame, *, k: int = 3, share: float = 0.7, method: str = "kmeans", refit: int = 0, min_samples: int = 30) -> DataFrame:
    """Out-of-sample states of each series: a model of its first `share` of bars, applied to the rest.

    method: kmeans, or gmm_hmm (mixture, Markov filter over its components).
    refit > 0 fits again on all bars before, every `refit` bars (walk-forward).
    """

    def kernel(b: dict[str, np.ndarray]) -> list[tuple]:
        x = np.stack([b[c] for c in FEATURES], axis=1).astype(float)
        n, ok, out = len(x), b["available"].astype(bool), []
        end = int(n * share) - 1
        at = end + 1
        while at < n:
            stop = min(n, at + refit) if refit else n
            train = np.flatnonzero(ok[:at])
            out += fitted(x, b, train, range(at, stop), at - 1)
            at = stop
        return out

    def fitted(x, b, train, test, through):
        if len(train) < min_samples:
            return []
        mean, scale = standardise(x[train])
        z = (x - mean) / scale
        test = np.array(list(test))
        if method == "kmeans":
            model = KMeans.fit(x[train], k, trained_through=through, min_samples=min_samples)
            if model is None:
                return []
            d = distances(z[test], np.array(model.centres))
            own = d.argmin(axis=1)
            far = np.sqrt(d[np.arange(len(test)), own])
            return [(int(b["i"][t]), int(b["time"][t]), model.states[c], 1 / (1 + f), through) for t, c, f in zip(test, own, far, strict=True)]
        if distinct_rows(z[train]) < k:
            return []
        mixture = GaussianMixture.fit(z[train], k)
        path = mixture.probabilities(z[train]).argmax(axis=1)
        chain = MarkovChain([""] * k, MarkovChain.initial(path, k), MarkovChain.estimate(path, k))
        belief = chain.forward(mixture.log_densities(z[np.concatenate([train, test])]))[len(train) :]
        names = states_of(mixture.means * scale + mean)
        return [(int(b["i"][t]), int(b["time"][t]), names[int(p.argmax())], float(p.max()), through) for t, p in zip(test, belief, strict=True)]

    return fold(features.select(*KEY, "i", "time", "available", *FEATURES), kernel, REGIME_SCHEMA)


class Lstm:
    """One LSTM layer and a linear head over sequences (rows, steps, inputs), trained by Adam with clipped gradients."""

    def __init__(self, inputs: int, hidden: int = 32, outputs: int = 4, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.p = {
            "w": rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden)),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)),
            "b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]),
            "v": rng.normal(0, 1 / np.sqrt(hidden), (hidden, outputs)),
            "c": np.zeros(outputs),
        }
        self.hidden = hidden

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, s, seen = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), []
        squash = lambda a: 1 / (1 + np.exp(-np.clip(a, -60, 60)))
        for t in range(steps):
            i, f, o, g = np.split(x[:, t] @ self.p["w"] + h @ self.p["u"] + self.p["b"], 4, axis=1)
            i, f, o, g = squash(i), squash(f), squash(o), np.tanh(g)
            before, was = s, h
            s = f * s + i * g
            h = o * np.tanh(s)
            seen.append((i, f, o, g, before, was, s))
        return h @ self.p["v"] + self.p["c"], [*seen, h]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        out, seen = self.forward(x)
        error = (out - y) * 2 / out.size
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"] = seen[-1].T @ error, error.sum(axis=0)
        dh, ds = error @ self.p["v"].T, 0.0
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, c, before, was, s = seen[t]
            ts = np.tanh(s)
            ds = ds + dh * o * (1 - ts**2)
            da = np.concatenate([ds * c * i * (1 - i), ds * before * f * (1 - f), dh * ts * o * (1 - o), ds * i * (1 - c**2)], axis=1)
            g["w"] += x[:, t].T @ da
            g["u"] += was.T @ da
            g["b"] += da.sum(axis=0)
            dh, ds = da @ self.p["u"].T, ds * f
        return float(((out - y) ** 2).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None, *, epochs: int = 30, batch: int = 64, rate: float = 1e-3, clip: float = 5.0, patience: int = 6, seed: int = 42) -> dict:
        """Early stopping on the held-out loss; the best weights are restored."""
        rng, best = np.random.default_rng(seed), (np.inf, 0, None)
        m, v, t, losses = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2)), None, 0, []
        m, v = m
        for epoch in range(1, epochs + 1):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                _, g = self.gradients(x[rows], y[rows])
                norm = np.sqrt(sum((a**2).sum() for a in g.values()))
                t += 1
                for k, a in g.items():
                    a = a * min(1.0, clip / max(norm, 1e-12))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            hx, hy = held or (x, y)
            losses.append(float(((self.forward(hx)[0] - hy) ** 2).mean()))
            if losses[-1] < best[0]:
                best = (losses[-1], epoch, {k: a.copy() for k, a in self.p.items()})
            elif epoch - best[1] >= patience:
                break
        self.p = best[2] or self.p
        return {"best_epoch": best[1], "losses": losses}

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def save(self, path: str, columns: list[str]) -> None:
        np.savez(path, columns=np.array(columns), hidden=self.hidden, **self.p)

    @classmethod
    def load(cls, path: str, columns: list[str]) -> Lstm:
        with np.load(path) as saved:
            if saved["columns"].tolist() != list(columns):
                raise ValueError("the model was trained on other columns")
            model = cls(len(saved["w"]), int(saved["hidden"]), len(saved["c"]))
            model.p = {k: saved[k] for k in model.p}
        return model
