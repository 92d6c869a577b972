"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents per Arrow batch: a batch of long texts then stays within tens of MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches, so that memory is bounded by the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch, name: str = "text") -> list[str]:
    """Texts of a record batch; a null text counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fold(mod: int):
    """crc32 of the id written as text, modulo ``mod``: the split into folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int) -> DataFrame:
    """(doc_id, text, y) for at most ``per_class`` labelled rows of each class.

    Rows are taken in order of a hash of their id, never from the held-out fold. The
    ids are bounded by ``2 * per_class``, so broadcasting them is safe at any size.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(~held_out).groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    ids = picked[0].unionByName(picked[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def newton(sums: Callable, size: int, l2: float, steps: int = 40) -> np.ndarray:
    """Newton's method from zero, with a ridge; ``sums`` gives gradient and Hessian at some coefficients."""
    w = np.zeros(size)
    for _ in range(steps):
        grad, hess = sums(w)
        move = np.linalg.solve(hess + l2 * np.eye(size), grad + l2 * w)
        w -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, steps: int = 40) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression by Newton's method."""
    weight = np.ones(len(y)) if weight is None else weight

    def sums(w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x

    return newton(sums, x.shape[1], l2, steps)
