"""Calibration, abstention bands and novelty cuts: fitted on validation rows, applied anywhere."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c, sigmoid
from ..session import cut
from . import roc
from .ordered import order_statistic, quantiles

# Fixed values of the calibration contract.
T_MIN, T_MAX = 0.05, 20.0
MIN_VAL_ROWS = 100
METHODS = ("temperature", "vector", "none")


@dataclass
class Calibration:
    """One run's calibration state, small enough to live on the driver and in JSON.

    ``ood_threshold`` is None where no novelty cut was fitted.
    """

    method: str = "temperature"
    temperature: float = 1.0
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.5
    threshold_criterion: str = "eer"
    conformal_lo: float = 0.5
    conformal_hi: float = 0.5
    conformal_alpha: float = 0.1
    ood_threshold: float | None = None
    fitted_on: str = "UNSET"
    n_val: int = 0
    degenerate: bool = False

    @classmethod
    def missing(cls) -> Calibration:
        """Identity transform at 0.5, saying so in ``fitted_on``."""
        return cls(method="none", fitted_on="MISSING (uncalibrated)")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([asdict(self)], CALIBRATION_DDL)

    @classmethod
    def from_json(cls, text: str | None) -> Calibration:
        if not text:
            return cls.missing()
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        state = cls(**{k: v for k, v in raw.items() if k in known})
        if state.ood_threshold is not None and state.ood_threshold == float("inf"):
            state.ood_threshold = None
        return state


CALIBRATION_DDL = (
    "method string, temperature double, a double, b double, threshold double, threshold_criterion string, "
    "conformal_lo double, conformal_hi double, conformal_alpha double, ood_threshold double, "
    "fitted_on string, n_val bigint, degenerate boolean"
)


# --------------------------------------------------------------------------
# apply
# --------------------------------------------------------------------------
def probability(z, cal: Calibration) -> Column:
    z = c(z)
    if cal.method == "temperature":
        return sigmoid(z / F.lit(max(cal.temperature, 1e-3)))
    if cal.method == "vector":
        return sigmoid(z * F.lit(cal.a) + F.lit(cal.b))
    if cal.method == "none":
        return sigmoid(z)
    raise ValueError(f"unknown calibration method {cal.method!r}")


def abstains(prob, cal: Calibration) -> Column:
    """True inside the band, both ends included."""
    return c(prob).between(F.lit(cal.conformal_lo), F.lit(cal.conformal_hi))


def energy(z, temperature: float = 1.0) -> Column:
    """Free-energy novelty of one logit, highest where the model is undecided.

    ``log(2 cosh(z / 2))`` is written as ``|z|/2 + log1p(exp(-|z|))``, which neither
    overflows nor loses digits.
    """
    half = F.abs(c(z) / F.lit(max(temperature, 1e-6)))
    return F.lit(-temperature) * (half / 2 + F.log1p(F.exp(-half)))


def apply_calibration(df: DataFrame, cal: Calibration, logit: str = "logit") -> DataFrame:
    """Add ``video_score``, ``calibrated_prob``, ``abstain`` and ``ood_score``."""
    scored = df.withColumns(
        {"video_score": sigmoid(logit), "calibrated_prob": probability(logit, cal), "ood_score": energy(logit)}
    )
    return scored.withColumn("abstain", abstains("calibrated_prob", cal))


def apply_calibrations(df: DataFrame, states: DataFrame, key: str, logit: str = "logit") -> DataFrame:
    """Apply many runs' states at once, by ``key``; a run without one gets the identity."""
    got = df.join(states, key, "left")
    method = F.coalesce("method", F.lit("none"))
    z = (
        F.when(method == "temperature", c(logit) / F.greatest("temperature", F.lit(1e-3)))
        .when(method == "vector", c(logit) * F.col("a") + F.col("b"))
        .otherwise(c(logit))
    )
    return got.withColumns(
        {
            "calibrated_prob": sigmoid(z),
            "threshold": F.coalesce("threshold", F.lit(0.5)),
            "conformal_lo": F.coalesce("conformal_lo", F.lit(0.5)),
            "conformal_hi": F.coalesce("conformal_hi", F.lit(0.5)),
            "fitted_on": F.coalesce("fitted_on", F.lit("MISSING (uncalibrated)")),
        }
    )


# --------------------------------------------------------------------------
# fit
# --------------------------------------------------------------------------
def _by_logit(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Counts per distinct logit, written out once since every Newton step reads them."""
    z = F.col(logit).cast("double")
    counts = df.where(z.isNotNull()).groupBy(z.alias("z")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("double").alias("y")
    )
    return cut(counts, "logits")


def fit_temperature(df: DataFrame, logit: str = "logit", label: str = "label", steps: int = 20) -> tuple[float, bool]:
    """Temperature that minimises mean cross-entropy, and whether it hit the clamp.

    The loss is convex in ``u = 1/T``; each Newton step is one aggregate.
    """
    data, u = _by_logit(df, logit, label), 1.0
    lo, hi = 1e-3, 1e3
    for _ in range(steps):
        p = f"(1 / (1 + exp(-z * {u!r}D)))"
        row = data.agg(
            F.expr(f"sum(({p} * n - y) * z)").alias("g"), F.expr(f"sum(n * {p} * (1 - {p}) * z * z)").alias("h")
        ).first()
        g, h = row["g"] or 0.0, row["h"] or 0.0
        if g > 0:
            hi = min(hi, u)
        elif g < 0:
            lo = max(lo, u)
        else:
            break
        new = u - g / h if h > 0 else (lo + hi) / 2
        if not lo < new < hi:
            new = (lo * hi) ** 0.5
        done, u = abs(new - u) <= 1e-12 * u, new
        if done:
            break
    t = 1.0 / u
    return min(max(t, T_MIN), T_MAX), not T_MIN <= t <= T_MAX


def fit_vector(df: DataFrame, logit: str = "logit", label: str = "label", steps: int = 30) -> tuple[float, float]:
    """Slope and shift of an unpenalised logistic fit, by Newton steps on aggregates."""
    data, a, b = _by_logit(df, logit, label), 1.0, 0.0
    for _ in range(steps):
        p = f"(1 / (1 + exp(-(z * {a!r}D + {b!r}D))))"
        w = f"n * {p} * (1 - {p})"
        r = data.agg(
            F.expr(f"sum(({p} * n - y) * z)").alias("ga"),
            F.expr(f"sum({p} * n - y)").alias("gb"),
            F.expr(f"sum({w} * z * z)").alias("haa"),
            F.expr(f"sum({w} * z)").alias("hab"),
            F.expr(f"sum({w})").alias("hbb"),
        ).first()
        det = r["haa"] * r["hbb"] - r["hab"] ** 2
        if det <= 1e-300:
            break
        da = (r["hbb"] * r["ga"] - r["hab"] * r["gb"]) / det
        db = (r["haa"] * r["gb"] - r["hab"] * r["ga"]) / det
        size = max(abs(da), abs(db))
        scale = 1.0 if size <= 5 else 5 / size
        a, b = a - scale * da, b - scale * db
        if size < 1e-10:
            break
    return a, b


def conformal_band(
    df: DataFrame, prob: str, label: str, alpha: float = 0.1, by: Sequence[str] = ()
) -> DataFrame:
    """Abstention band ``[lo, hi]`` per group from split-conformal scores.

    The cut is the order statistic at ``ceil(level * (n - 1))``, level being
    ``min(ceil((n + 1)(1 - alpha)) / n, 1)``.
    """
    wrong = F.lit(1.0) - F.when(F.col(label) == 1, F.col(prob)).otherwise(F.lit(1.0) - F.col(prob))
    index = f"ceil(least(ceil((n + 1) * {1 - alpha!r}D) / n, 1D) * (n - 1))"
    q = order_statistic(df.withColumn("_nc", wrong), "_nc", index, by, "q")
    return q.select(
        *by,
        "n",
        F.least(F.col("q"), 1 - F.col("q")).alias("conformal_lo"),
        F.greatest(F.col("q"), 1 - F.col("q")).alias("conformal_hi"),
    )


def ood_cut(df: DataFrame, score: str, q: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, score, {"ood_threshold": q}, by)


def fit_calibration(
    val: DataFrame,
    method: str = "temperature",
    criterion: str = "eer",
    alpha: float = 0.1,
    ood_q: float | None = 0.95,
    logit: str = "logit",
    label: str = "label",
    fitted_on: str = "source val",
) -> Calibration:
    """Fit everything on validation rows: transform, threshold, band, novelty cut.

    The threshold and band come from calibrated probabilities, so they share a space.
    """
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}")
    cal = Calibration(method=method, threshold_criterion=criterion, conformal_alpha=alpha, fitted_on=fitted_on)
    clamped = False
    if method == "temperature":
        cal.temperature, clamped = fit_temperature(val, logit, label)
    elif method == "vector":
        cal.a, cal.b = fit_vector(val, logit, label)
    scored = val.select(label, logit).withColumn("_p", probability(logit, cal))
    cal.threshold = roc.threshold_value(scored, label, "_p", criterion)
    band = conformal_band(scored, "_p", label, alpha).first()
    if band is None:
        cal.conformal_lo = cal.conformal_hi = cal.threshold
    else:
        cal.n_val = int(band["n"])
        cal.conformal_lo, cal.conformal_hi = float(band["conformal_lo"]), float(band["conformal_hi"])
    cal.degenerate = clamped or cal.n_val < MIN_VAL_ROWS
    if ood_q is not None and cal.n_val:
        cal.ood_threshold = float(
            ood_cut(scored.withColumn("_e", energy(logit)), "_e", ood_q).first()["ood_threshold"]
        )
    return cal
