"""Quality scores: kernel ridge by random Fourier features, calibrated by isotonic regression.

A document's statistics (shares of byte classes, words, lines, repetition) are
standardised and mapped to ``cos(Wx + b)`` features, whose inner products
approximate a Gaussian kernel. Each partition adds up its part of the normal
equations for each of ``FOLDS`` folds; the sums are all that leaves it. The
ridge penalty is chosen, and the isotonic calibration fitted, on scores of folds
that the respective weights have not seen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import mapped, squeezed, store, tree_sum

FEATURES = 256
FOLDS = 5
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
BINS = 2000
_GROUPS = [
    np.arange(65, 91), np.arange(97, 123), np.arange(48, 58), np.array([32]), np.array([10, 13]), np.array([9]), np.array([46]), np.array([44]), np.array([33]), np.array([63]),
    np.array([124]), np.array([35, 36, 37, 38, 42]), np.array([58, 59]), np.array([60, 62, 123, 125, 91, 93, 61]), np.array([47, 92, 95, 64]), np.array([34, 39, 40, 41, 45]), np.arange(128, 256),
]
STATISTICS = len(_GROUPS) + 12


def statistics(text: str | None) -> np.ndarray:
    """Numbers of one whole text; 0 throughout for a null or empty one."""
    out = np.zeros(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    if not raw:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    k = len(_GROUPS)
    out[:k] = [np.sqrt(hist[g].sum() / len(raw)) for g in _GROUPS]
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = len(set(words))
    out[k:] = [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n / 10, kinds / n, np.log1p(kinds) / np.log1p(n), np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)), hist[46] / n, np.log1p(max(map(len, words), default=0)), np.log1p((hist > 0).sum()), len({*words[::2]}) / max(1, len(words[::2])),
    ]
    return out


class Map:
    """Standardisation and random features, the same for all rows."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over rising scores: block ends and their share of good rows."""
    ends, value, w = [], [], []
    for s, g, n in zip(score, good, weight, strict=True):
        ends.append(s)
        value.append(g / n)
        w.append(n)
        while len(value) > 1 and value[-2] >= value[-1]:
            n2, v2 = w.pop(), value.pop()
            ends[-2:] = [ends[-1]]
            value[-1] = (value[-1] * w[-1] + v2 * n2) / (w[-1] + n2)
            w[-1] += n2
    return np.array(ends), np.array(value)


class Model:
    def __init__(self, features: Map, weights: np.ndarray, ends: np.ndarray, value: np.ndarray):
        self.features, self.weights, self.ends, self.value = features, weights, ends, value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, linear between block ends, kept apart within a block by a hair of the raw score."""
        raw = self.features(x) @ self.weights
        return np.clip(0.999 * np.interp(raw, self.ends, self.value) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def measure(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: statistics of each row's text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t).tobytes() for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = mapped(rows, run, "doc_id string, x binary")
    return store(out.withColumn("doc_id", F.col("doc_id").cast("long")), "statistics")


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, STATISTICS)


def _summed(rows: DataFrame, fn) -> np.ndarray | None:
    from pyspark import TaskContext

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = fn(pdf)
                total = x if total is None else total + x
        if total is not None:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "blob": [squeezed(total)]})

    return tree_sum(store(rows.mapInPandas(run, "slot int, blob binary"), "sums"), "float64")


def fit(measured: DataFrame, labels: DataFrame) -> Model | None:
    """From ``(doc_id, x)`` and ``(doc_id, quality)`` with quality 0 or 1; None without any such row."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = store(measured.join(marked, "doc_id").select("x", F.col("quality").cast("double").alias("y"), fold.alias("fold")), "train")

    def moments(pdf):
        x = _matrix(pdf["x"])
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _summed(train, moments)
    if m is None:
        return None
    mean = m[1 : 1 + STATISTICS] / m[0]
    scale = np.sqrt(np.maximum(m[1 + STATISTICS :] / m[0] - mean**2, 0)) + 1e-3
    features, d = Map(mean, scale), FEATURES + 1

    def equations(pdf):
        z, y, k = features(_matrix(pdf["x"])), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
        out = np.zeros((FOLDS, d, d + 2))
        for i in range(FOLDS):
            a, b = z[k == i], y[k == i]
            out[i, :, :d], out[i, :, d], out[i, 0, d + 1] = a.T @ a, a.T @ b, len(b)
        return out.ravel()

    sums = _summed(train, equations).reshape(FOLDS, d, d + 2)
    whole = sums.sum(axis=0)

    def solve(s, penalty):
        return np.linalg.solve(s[:, :d] + penalty * max(1.0, s[0, d + 1]) * np.eye(d) / d, s[:, d])

    unseen = np.stack([[solve(whole - s, p) for s in sums] for p in PENALTIES])

    def error(pdf):
        z, y, k = features(_matrix(pdf["x"])), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
        return np.array([((np.einsum("ij,ij->i", z, w[k]) - y) ** 2).sum() for w in unseen])

    best = int(_summed(train, error).argmin())
    crossed = unseen[best]

    def graph(pdf):
        z, y, k = features(_matrix(pdf["x"])), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
        at = np.clip(((np.einsum("ij,ij->i", z, crossed[k]) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    n, good = _summed(train, graph).reshape(2, BINS)
    some = np.flatnonzero(n)
    ends, value = isotonic((some + 0.5) / BINS * 2 - 0.5, good[some], n[some])
    return Model(features, solve(whole, PENALTIES[best]), ends, value)


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` for each row, repeated ones too; 0.5 if there was nothing to learn from."""
    shared = measured.sparkSession.sparkContext.broadcast(model)  # weights of FEATURES features and at most BINS blocks

    def run(batches):
        for pdf in batches:
            if len(pdf):
                m = shared.value
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": m(_matrix(pdf["x"])) if m else 0.5})

    out = measured.select(F.col("doc_id").cast("string").alias("doc_id"), "x").mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
