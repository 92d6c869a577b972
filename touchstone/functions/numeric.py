"""Numeric column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x, n: int) -> Column:
    """Round half up at ``n`` decimals in plain IEEE steps, the same on any engine."""
    k = float(10**n)
    return F.floor(c(x).cast("double") * k + 0.5) / F.lit(k)


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def ratio(a, b) -> Column:
    """Double division that yields null, not an error, on a zero divisor."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def sigmoid(z) -> Column:
    z = c(z)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logit(p, eps: float = 1e-4) -> Column:
    p = clip(p, eps, 1.0 - eps)
    return F.log(p / (F.lit(1.0) - p))


def half_open_bin(x, n_bins: int) -> Column:
    """Bin index with bins (lo, hi], the first closed on both sides; null outside [0, 1].

    Edges are ``j * (1 / n_bins)``; a guess from ``ceil`` is corrected against them so
    that values lying on an edge fall where the edge array says.
    """
    x = c(x)
    step = F.lit(1.0 / n_bins)
    k = F.ceil(x * n_bins).cast("int")
    k = F.when(x <= (k - 1) * step, k - 1).when(x > k * step, k + 1).otherwise(k)
    k = F.least(F.greatest(k, F.lit(1)), F.lit(n_bins))
    return F.when((x >= 0) & (x <= 1), k - 1)


def closed_open_bin(x, n_bins: int) -> Column:
    """Bin index with bins [lo, hi), the last closed; ``x`` is clipped to [0, 1] first."""
    x = clip(x, 0.0, 1.0)
    step = F.lit(1.0 / n_bins)
    k = F.floor(x * n_bins).cast("int")
    k = F.when(x < k * step, k - 1).when(x >= (k + 1) * step, k + 1).otherwise(k)
    return F.least(F.greatest(k, F.lit(0)), F.lit(n_bins - 1))


def lower_int(x) -> Column:
    """Truncate toward zero, as an integer cast of a float does."""
    x = c(x)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")
