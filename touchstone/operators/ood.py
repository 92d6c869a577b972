"""Mahalanobis novelty: a mean and a precision matrix, fitted once, applied as columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import c


@dataclass
class Mahalanobis:
    """Fitted state: ``d`` means and a ``d x d`` matrix, whatever the row count."""

    mean: list[float]
    precision: list[list[float]]
    n_fit: int

    @property
    def dim(self) -> int:
        return len(self.mean)


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Add up per-partition partial vectors, keyed by ``i``."""
    flat = rows.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    vectors = flat.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("v")).collect()
    return {r["i"]: np.array([e["x"] for e in r["v"]]) for r in vectors}


def fit_mahalanobis(df: DataFrame, vec: str, shrinkage: float = 0.1) -> Mahalanobis | None:
    """Mean and shrunken precision; None unless there are more rows than dimensions.

    Each partition reduces to one centred Gram matrix in its task; only ``d`` rows of
    ``d`` sums per partition are shuffled, and a ``d x d`` matrix reaches the driver.
    """
    data = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("x"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b["x"].to_numpy())
                part = np.append(m.sum(axis=0), len(m))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": [0], "v": [total.tolist()]})

    sums = _summed(data.mapInPandas(first, "i int, v array<double>"))
    if not sums:
        return None
    n, mean = int(round(sums[0][-1])), sums[0][:-1] / sums[0][-1]
    d = len(mean)
    if n <= d:
        return None

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((d, d))
        for b in batches:
            if len(b):
                m = np.stack(b["x"].to_numpy()) - mean
                gram += m.T @ m
        yield pd.DataFrame({"i": range(d), "v": gram.tolist()})

    rows = _summed(data.mapInPandas(second, "i int, v array<double>"))
    cov = np.stack([rows[i] for i in range(d)]) / max(n - 1, 1)
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d)
    return Mahalanobis(mean.tolist(), np.linalg.pinv(cov).tolist(), n)


def whitening(state: Mahalanobis) -> np.ndarray:
    """``w`` with precision = w w', so that a distance is the squared length of (x - mean) w.

    By Cholesky where the precision is definite, else by its eigenvectors.
    """
    p = np.asarray(state.precision, float)
    p = (p + p.T) / 2
    try:
        return np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(p)
        return vectors * np.sqrt(np.clip(values, 0, None))


def mahalanobis(vec, state: Mahalanobis | None) -> Column:
    """Squared distance of a vector from the fitted centre; 0 where nothing was fitted.

    One matrix product per Arrow batch, no shuffle; the plan has the same size for any
    dimension. Null for a null vector, one of another length, or one with null or NaN parts.
    """
    if state is None:
        return F.lit(0.0)
    mean, w = np.asarray(state.mean, float), whitening(state)

    @F.arrow_udf(T.DoubleType())
    def distance(v: pa.Array) -> pa.Array:
        good = pc.fill_null(pc.equal(pc.list_value_length(v), len(mean)), False)
        x = v.filter(good).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(mean))
        found = np.full(len(v), np.nan)
        found[good.to_numpy(zero_copy_only=False)] = (((x - mean) @ w) ** 2).sum(1)
        return pa.array(found, mask=np.isnan(found))

    return distance(c(vec).cast("array<double>"))
