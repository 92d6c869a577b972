"""Per-clip frame arithmetic on array columns: sampling, windows, signatures, reliability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import hash_fraction
from .numeric import c, half_up

MIN_FACE_PX = 48
WINDOW_FRAMES = 16


def spaced(last: Column, n: int) -> Column:
    """``n`` evenly spaced whole numbers from 0 to ``last``, the end forced."""
    if n == 1:
        return F.array(F.lit(0).cast("bigint"))
    step = last / F.lit(float(n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i == n - 1, last.cast("bigint")).otherwise(F.floor(i * step).cast("bigint")),
    )


def frame_indices(n_total, n_want: int, strategy: str = "uniform", seed=None) -> Column:
    """Which frames to read. Short clips give every frame once.

    ``random`` draws without replacement in ``n_want`` hashed steps, whatever the clip's
    length: step ``i`` picks from the first ``n - n_want + i + 1`` frames, and takes the
    last of these if its pick is already in.
    """
    if strategy not in ("uniform", "dense", "random"):
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    n = F.greatest(c(n_total).cast("bigint"), F.lit(1).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), n - 1)
    if strategy == "uniform":
        chosen = spaced(n - 1, n_want)
    elif strategy == "dense":
        start = F.floor((n - n_want) / 2).cast("bigint")
        chosen = F.sequence(start, start + n_want - 1)
    else:
        s = F.lit("0") if seed is None else c(seed).cast("string")

        def draw(acc: Column, i: Column) -> Column:
            top = n - n_want + i
            pick = F.floor(hash_fraction(F.concat(s, F.lit(":"), i.cast("string"))) * (top + 1))
            return F.array_append(acc, F.when(F.array_contains(acc, pick), top).otherwise(pick))

        steps = F.sequence(F.lit(0).cast("bigint"), F.lit(n_want - 1).cast("bigint"))
        chosen = F.array_sort(F.aggregate(steps, F.array().cast("array<bigint>"), draw))
    return F.when(n <= n_want, every).otherwise(chosen)


def resample(values, n: int) -> Column:
    """Exactly ``n`` entries, evenly picked or repeated."""
    v = c(values)
    size = F.size(v)
    return F.when(size > 0, F.transform(spaced((size - 1).cast("bigint"), n), lambda i: F.get(v, i.cast("int"))))


def timestamps(indices, fps) -> Column:
    return F.transform(c(indices), lambda i: half_up(i / c(fps), 4))


def windows(values, n: int, length: int = WINDOW_FRAMES) -> Column:
    """``n`` overlapping windows of fixed length; short series repeat their last entry."""
    v = c(values)
    size = F.size(v)
    padded = F.when(
        size < length, F.concat(v, F.array_repeat(F.element_at(v, -1), length - size))
    ).otherwise(v)
    last = F.greatest(F.size(padded) - length, F.lit(0)).cast("bigint")
    return F.when(
        size > 0, F.transform(spaced(last, n), lambda s: F.slice(padded, (s + 1).cast("int"), length))
    )


def drop_small_faces(boxes, min_px: int = MIN_FACE_PX) -> Column:
    """Null out boxes whose short side is under the limit; positions are kept."""
    return F.transform(
        c(boxes), lambda b: F.when(F.least(b[2] - b[0], b[3] - b[1]) >= min_px, b)
    )


def reliability(snr, confidences, mouth_ok, n_frames, blurs, has_audio, mouth_available) -> Column:
    """Reliability values in contract order; streams that are off count as zero."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    seen = F.filter(c(confidences), lambda x: x > 0)
    return F.array(
        F.when(c(has_audio), half_up(snr, 4)).otherwise(0.0),
        half_up(F.coalesce(mean(seen), F.lit(0.0)), 4),
        F.when(c(mouth_available), half_up(c(mouth_ok) / F.greatest(c(n_frames), F.lit(1)), 4)).otherwise(0.0),
        half_up(F.coalesce(mean(c(blurs)), F.lit(0.0)), 4),
    )


def mouth_available(mouth_ok, n_frames) -> Column:
    return c(mouth_ok) >= F.greatest(F.lit(4), F.floor(c(n_frames) / 4).cast("int"))


def bit_signature(values) -> Column:
    """64-bit signature of 64 numbers: a bit is set where the value beats the median.

    The first value (the constant term of a transform) takes no part in the median.
    Most significant bit first; returned as a signed long.
    """
    v = c(values)
    rest = F.array_sort(F.slice(v, 2, 63))
    median = F.element_at(rest, 32)
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > median).cast("bigint")))


def cosine_basis(size: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(size)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))
    return scale * np.cos(np.pi * (2 * x + 1) * k / (2 * size))


def cosine_transform_2d(pixels, size: int, keep: int = 8) -> Column:
    """Top-left ``keep x keep`` block of the orthonormal 2-D cosine transform.

    ``pixels`` is one row's flat ``size x size`` grey patch. Arrow batches of patches
    are transformed with two matrix products.
    """
    basis = cosine_basis(size, keep)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def transform(rows: pd.Series) -> pd.Series:
        block = np.stack(rows.to_numpy()).reshape(-1, size, size)
        return pd.Series(list((basis @ block @ basis.T).reshape(len(block), keep * keep)))

    return transform(c(pixels))
