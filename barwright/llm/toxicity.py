"""Toxicity by a chain of linear classifiers, one for each category.

The categories are predicted one after the other; each later model also sees
the probabilities of the earlier ones. While training, those probabilities are
out of fold: they come from models that have not seen the document, so a later
model learns to trust them only as far as they deserve. The last category is
the verdict, and its cutoff comes from out-of-fold probabilities too.

Categories are columns of the labels, if named. Labels that only say toxic or
not are divided into KINDS kinds, learnt from them: the features that toxic
documents have more often than others are grouped by how often they occur
together (the sign of the second eigenvector of their normalised co-occurrence),
and a toxic document is of each kind whose features it has.

Features are words and word beginnings of PREFIXES letters, so inflected forms
count together. The chain is trained on at most `sample` labelled documents
(those with the least hash of their id, a bound that is a parameter); its
vocabulary is the features whose document frequencies differ most between toxic
and other documents of that sample. Scoring reads every whole text once, where
it is, with `vocabulary` weights a category; nothing is shuffled.

Defined results: null and blank texts have no words, probability 0, and are not
rejected; with labels of one class only nothing is rejected; repeated rows are
scored separately; other columns pass through, but for those of the names that
score() adds.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings; a feature that is one ends in a star.
PREFIXES = (4, 5, 6)
KINDS = 2
FOLDS = 4
#: Words of the table that a task keeps of which features a word has.
KEEP = 1 << 17


class Features:
    """Counts of the features of a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Features, (self.vocabulary,)

    def learnt(self, word: str) -> tuple[int, ...]:
        names = (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k))
        self.known[word] = out = tuple(i for i in map(self.index.get, names) if i is not None)
        return out

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Rows of feature counts, and the number of words in a last column."""
        out = np.zeros((len(texts), len(self.vocabulary) + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = WORD.findall((text or "").lower())
            row[-1] = len(words)
            for word in words:
                hits = self.known.get(word)
                for i in self.learnt(word) if hits is None else hits:
                    row[i] += 1
            if len(self.known) > KEEP:
                self.known = {}
        return out


def features(counted: np.ndarray) -> np.ndarray:
    """Log counts, and per-hundred-word densities, of every feature."""
    counted = counted.astype(np.float32)
    words = np.maximum(counted[:, -1:], 1)
    each = counted[:, :-1]
    return np.concatenate([np.log1p(each), np.minimum(100 * each / np.maximum(words, 20), 5)], axis=1)


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights and intercept of an L2-penalised logistic regression, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = probability(x[:, :-1], w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def kinds(present: np.ndarray) -> np.ndarray:
    """For each feature (a column of 0 and 1 over toxic documents) its kind, 0 or 1: those that occur together are of one."""
    both = present.T @ present
    root = np.sqrt(np.maximum(both.sum(axis=1), 1e-9))
    _, vectors = np.linalg.eigh(both / root[:, None] / root[None, :])
    side = (vectors[:, -2] / root > 0).astype(int) if present.shape[1] > 1 else np.zeros(present.shape[1], int)
    return side if present[:, side == 0].sum() >= present[:, side == 1].sum() else 1 - side


def cutoff(p: np.ndarray, toxic: np.ndarray, false_share: float) -> float:
    """The middle of the gap, in log odds, above the least cutoff that rejects at most `false_share` of clean documents."""
    logit = np.log(p / (1 - p))
    clean, bad = np.sort(logit[~toxic]), np.sort(logit[toxic])
    low = clean[max(0, int(np.ceil((1 - false_share) * len(clean))) - 1)]
    above = bad[bad > low]
    high = min(above[0] if len(above) else low, max(low, 0.0))
    return float(1 / (1 + np.exp(-(low + high) / 2)))


class Chain:
    def __init__(self, categories: list[str], counter: Features, weights: list[np.ndarray], threshold: float):
        self.categories, self.counter, self.weights, self.threshold = categories, counter, weights, threshold

    @classmethod
    def fit(cls, categories: list[str], counter: Features, x: np.ndarray, labels: np.ndarray, fold: np.ndarray, false_share: float) -> Chain:
        weights, seen = [], x
        held_out = np.zeros(len(x))
        for y in labels.T:
            weights.append(fit_linear(seen, y))
            held_out = np.zeros(len(y))
            for f in range(FOLDS):
                held_out[fold == f] = probability(seen[fold == f], fit_linear(seen[fold != f], y[fold != f]))
            seen = np.concatenate([seen, held_out[:, None].astype(x.dtype)], axis=1)
        return cls(categories, counter, weights, cutoff(held_out, labels[:, -1] > 0, false_share))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.concatenate([out, probability(np.concatenate([x, out], axis=1), w)[:, None]], axis=1)
        return out


def _count(batches: Iterator[pa.RecordBatch], counter: Features, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = counter.counts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([r.tobytes() for r in rows], pa.binary())], names=[*names, "counts"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = (), sample: int = 6000, vocabulary: int = 128, false_share: float = 0.001) -> Chain | None:
    """The chain fitted to docs that labels (doc_id, toxic and other categories) covers; None if they hold one class only.

    `false_share` bounds the clean documents of the sample that the cutoff rejects out of fold.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id"))
    chosen = known.agg(*(F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)).alias(c) for c in (*categories, "toxic")))
    chosen = chosen.withColumn("__h", F.xxhash64(F.col("__id").cast("string"))).orderBy("__h", "__id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    rows = rows.select(*categories, "toxic", F.pmod("__h", F.lit(FOLDS)).cast("int").alias("fold"), "text").persist()
    try:
        sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if len(sizes) < 2 or min(sizes.values()) < 2 * FOLDS:
            return None
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}]+"), F.lit(0)))
        begin = lambda k: F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
        seen = rows.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", *map(begin, PREFIXES)))).alias("word"))
        rate = lambda k: F.sum((F.col("toxic") == k).cast("int")) / sizes[k]
        told = seen.groupBy("word").agg(rate(1).alias("in"), rate(0).alias("out"))
        told = told.withColumn("gain", F.abs(F.sqrt("in") - F.sqrt("out")))
        best = told.orderBy(F.desc("gain"), F.length("word"), "word").limit(vocabulary).collect()
        counter = Features([r.word for r in best])
        names = [*categories, "toxic", "fold"]
        counted = rows.mapInArrow(functools.partial(_count, counter=counter, names=names), f"{', '.join(f'{c} int' for c in names)}, counts binary").toPandas()
    finally:
        rows.unpersist()
    x = np.stack([np.frombuffer(b, np.float32) for b in counted["counts"]])
    toxic, fold = counted["toxic"].to_numpy() > 0, counted["fold"].to_numpy()
    targets = {c: counted[c].to_numpy() > 0 for c in categories}
    if not categories:
        signs = np.flatnonzero([r["in"] > r["out"] for r in best])
        side = kinds((x[toxic][:, signs] > 0).astype(float))
        targets = {f"kind_{k + 1}": toxic & (x[:, signs[side == k]].sum(axis=1) > 0) for k in range(KINDS)}
    targets["toxic"] = toxic
    return Chain.fit(list(targets), counter, features(x), np.stack(list(targets.values()), axis=1).astype(np.float64), fold, false_share)


def _score(batches: Iterator[pa.RecordBatch], chain: Chain, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, at):
            counted = chain.counter.counts(part.column(at).to_pylist())
            scores = chain.scores(features(counted)) * (counted[:, -1:] > 0)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(s) for s in scores.T)], names=names)


def score(docs: DataFrame, chain: Chain | None, *, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with p_<category> columns and `toxic`, the verdict (the chain's own cutoff, if none is given). Columns of these names in docs are replaced."""
    new = [f"p_{c}" for c in (chain.categories if chain else [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"])]
    docs = docs.drop(*new, "toxic")
    if chain is None:
        return docs.select("*", *(F.lit(0.0).alias(c) for c in new), F.lit(False).alias("toxic"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])
    scored = docs.mapInArrow(functools.partial(_score, chain=chain, at=docs.columns.index(text_col), names=[*docs.columns, *new]), schema)
    return scored.withColumn("toxic", F.col(new[-1]) >= (chain.threshold if threshold is None else threshold))
