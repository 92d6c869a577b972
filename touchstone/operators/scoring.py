"""Batch scoring with a user's model: failures become rows, not job failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import verdicts as V
from .calibration import Calibration

SCORED = T.StructType(
    [
        T.StructField("logit", T.DoubleType()),
        T.StructField("frame_logits", T.ArrayType(T.DoubleType())),
        T.StructField("error", T.StringType()),
    ]
)


def score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], keep: list[str] | None = None) -> DataFrame:
    """Run ``predict`` over Arrow batches; it returns ``logit`` and maybe ``frame_logits``.

    A batch that raises is halved until the failing rows stand alone, so one bad clip
    costs one row: its ``error`` is ``Type: message`` and its logit null. Rows are put
    together once per batch, not per piece.
    """
    keep = keep or df.columns
    schema = T.StructType([df.schema[k] for k in keep] + list(SCORED))

    def fill(batch: pd.DataFrame, logits: np.ndarray, frames: list, errors: list) -> None:
        """What ``predict`` says of each row, or its error."""

        def attempt(lo: int, hi: int, fails: bool = False) -> bool:
            """Score rows ``lo`` to ``hi``; true if that took one call. A range known to fail is halved unasked."""
            if not fails or hi - lo == 1:
                try:
                    out = predict(batch.iloc[lo:hi])
                    got = np.asarray(out["logit"], dtype="float64")
                    seen = list(out["frame_logits"]) if "frame_logits" in out else [[]] * (hi - lo)
                    if not len(got) == len(seen) == hi - lo:
                        raise ValueError(f"{hi - lo} rows in, {len(got)} out")
                    logits[lo:hi], frames[lo:hi] = got, seen
                    return True
                except Exception as e:  # noqa: BLE001 - narrowed down to the failing rows
                    if hi - lo == 1:
                        errors[lo] = f"{type(e).__name__}: {e}"
                        return False
            half = (lo + hi) // 2
            # If the first half passes, it is the second one that fails.
            attempt(half, hi, attempt(lo, half))
            return False

        attempt(0, len(batch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            logits, frames, errors = np.full(n, np.nan), [[]] * n, [""] * n
            if n:
                fill(batch, logits, frames, errors)
            yield batch[keep].reset_index(drop=True).assign(logit=logits, frame_logits=frames, error=errors)

    out = df.mapInPandas(run, schema)
    return out.withColumn("logit", F.when(F.col("error") == "", F.col("logit")))


def batch_verdicts(df: DataFrame, predict, cal: Calibration, keep: list[str] | None = None) -> DataFrame:
    """Scored clips with verdicts; a failed clip's verdict is ``error``."""
    scored = V.score_logits(score(df, predict, keep), cal)
    failed = F.col("error") != ""
    blank = lambda k: F.when(~failed, F.col(k))
    return scored.withColumns(
        {
            "verdict": F.when(failed, "error").otherwise(F.col("verdict")),
            "calibrated_prob": blank("calibrated_prob"),
            "ood_flag": blank("ood_flag"),
        }
    )
