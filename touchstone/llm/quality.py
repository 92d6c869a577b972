"""Quality scores by Bradley-Terry ranking.

A pair (better, worse) of labelled documents is a preference; the chance that one beats
the other is the logistic function of the difference of their worths, and a worth is
linear in text statistics. Fitting it is a logistic regression on feature differences.
Worths become scores through the quantile of the training worths that cuts off the
share of bad documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, logistic, map_arrow, texts_of

#: At most so many labelled documents of each class are read to fit the ranking.
TRAIN_PER_CLASS = 4000
#: Preference pairs that are drawn from them.
PAIRS = 60000
CUT = 0.7

_MARKS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{}~", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str) -> list[float]:
    """Counts of one whole text as ratios; an empty text gives zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * 15
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    same = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        upper / (upper + lower + 1.0),
        counts[48:58].sum() / size,
        counts[_MARKS].sum() / n,
        counts[33] / n,
        counts[124] / n,
        counts[_STOPS].sum() / n,
        counts[10] / n,
        same / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(words)) / n,
        (1 - len(set(words)) / n) / np.log2(n + 2),
        np.log1p(n),
        size / n,
        1.0 if n < 5 else 0.0,
        counts[128:].sum() / size,
    ]


def features(texts: list[str]) -> np.ndarray:
    """Statistics with saturating copies, so that a mild share of junk already counts."""
    base = np.array([statistics(t) for t in texts], float).reshape(-1, 15)
    soft = np.tanh(base[:, [0, 2, 3, 4, 7, 8]] * np.array([5, 4, 4, 4, 6, 4]))
    return np.hstack([base, soft])


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the quantile that separates good from bad."""
        worth = (x - self.mean) / self.scale @ self.weights
        z = (worth - self.cut) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Ranking:
    """Bradley-Terry worths from preferences of label 1 over label 0.

    With one class only there is no preference: every score is the same and kept.
    """
    if not len(y) or y.min() == y.max():
        k = features([""]).shape[1]
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = logistic(diff, np.ones(pairs), l2=1e-4 * pairs)
    worth = z @ w
    # The quantile: where the two classes' error rates together are least.
    order = np.sort(worth)
    quantiles = np.unique(np.quantile(order, np.linspace(0.001, 0.999, 999)))
    miss = np.array([(worth[good] < q).mean() + (worth[bad] >= q).mean() for q in quantiles])
    best = np.flatnonzero(miss <= miss.min() + 1e-12)
    cut = float(quantiles[best].mean())
    spread = max(1e-6, float(np.median(np.abs(worth - cut))) / 2)
    return Ranking(mean, scale, w, cut, spread)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Ranking:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", fold(4) == 2, per_class)

    def run(batches):
        for b in batches:
            x = features(texts_of(b))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) if len(x) else pa.array([])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), flat.cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = map_arrow(sample, run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), -1) if len(rows) else features([])
    return fit(x, rows["y"].to_numpy())


def score(docs: DataFrame, ranking: Ranking, out: str = "score") -> DataFrame:
    """Add a score to every row; a null text scores like an empty one.

    Rows are neither dropped nor merged. A column already named ``out`` is replaced.
    """
    kept = [k for k in docs.columns if k != out]
    names = [*kept, out]

    def run(batches):
        for b in batches:
            s = ranking.score(features(texts_of(b)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(s, pa.float64())], names)

    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema
    return map_arrow(docs.select(*kept), run, schema)
