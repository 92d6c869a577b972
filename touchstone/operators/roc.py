"""ROC-based metrics, grouped and exact.

Every metric starts from one *score table*: positives and negatives per group and
distinct score (combined map-side, so ties and hot groups shrink before the shuffle),
with running counts from the highest score down. Metrics are then plain aggregates of
that table. A group with one class yields null where a ratio is undefined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import erfc, exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ratio
from ..session import cut
from . import bootstrap
from .ordered import ALL, gone, keyed, running_sums, score_level

TINY = 1e-12
INF = float("inf")


def usable(label: str, score: str) -> Column:
    """Rows that a metric can use: a label, and a score that is a number.

    Rows without are left out of every metric; compare ``n`` with the table's count to
    see how many.
    """
    s = F.col(score).cast("double")
    return F.col(label).isNotNull() & s.isNotNull() & ~F.isnan(s)


def score_table(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per (group, distinct score) with counts at, above and in total."""
    df, keys = keyed(df, by)
    w = f"CAST(`{weight}` AS BIGINT)" if weight else "1L"
    pts = (
        df.where(usable(label, score))
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(
            F.expr(f"sum(CASE WHEN `{label}` = 1 THEN {w} ELSE 0L END) AS pos"),
            F.expr(f"sum(CASE WHEN `{label}` = 1 THEN 0L ELSE {w} END) AS neg"),
        )
    )
    if weight:
        pts = pts.where("pos + neg > 0")
    return curve_table(pts, keys)


def curve_table(pts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The score table from counts (keys, score, pos, neg), one row per score."""
    table = running_sums(
        pts, keys, [score_level("score", descending=True)], ["-score"], ["pos", "neg"], peek=["pos", "neg"]
    )
    # A point inside a straight run of the curve carries no information: it is one
    # whose step equals the next step. First and last points always stay.
    return table.selectExpr(
        "*",
        "pos_before + pos AS tps",
        "neg_before + neg AS fps",
        "try_divide(CAST(pos_before AS DOUBLE), pos_total) AS tpr_from",
        "try_divide(CAST(neg_before AS DOUBLE), neg_total) AS fpr_from",
        "try_divide(CAST(pos_before + pos AS DOUBLE), pos_total) AS tpr",
        "try_divide(CAST(neg_before + neg AS DOUBLE), neg_total) AS fpr",
        """pos_before + neg_before = 0 OR following IS NULL
           OR following.pos <> pos OR following.neg <> neg AS corner""",
    )


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Corner points of the curve per group, led by (0, 0) at threshold +inf."""
    table = score_table(df, label, score, by)
    keys = list(by) or [ALL]
    start = table.select(*keys).distinct().select(
        *keys, F.lit(INF).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    points = table.where("corner").select(*keys, F.col("score").alias("threshold"), "fpr", "tpr")
    return points.unionByName(start).drop(*gone(by))


# --------------------------------------------------------------------------
# aggregates over the score table
# --------------------------------------------------------------------------
BOTH = "max(pos_total) > 0 AND max(neg_total) > 0"


def both_classes() -> Column:
    return F.expr(BOTH)


def _if_both(sql: str) -> Column:
    return F.expr(f"CASE WHEN {BOTH} THEN {sql} END")


def auc_agg() -> Column:
    """Mann-Whitney form: each negative counts the positives above it, half for ties."""
    return F.expr(
        "try_divide(sum(neg * (pos_before + pos * 0.5D)), CAST(max(pos_total) AS DOUBLE) * max(neg_total))"
    )


def partial_auc_agg(max_fpr: float) -> Column:
    """Area up to ``max_fpr``, rescaled so that chance is one half."""
    m, least = f"{max_fpr}D", 0.5 * max_fpr**2
    cut_y = f"(tpr_from + (tpr - tpr_from) * try_divide({m} - fpr_from, fpr - fpr_from))"
    area = f"""sum(CASE WHEN fpr <= {m} THEN (fpr - fpr_from) * (tpr_from + tpr) / 2
        WHEN fpr_from < {m} THEN ({m} - fpr_from) * (tpr_from + {cut_y}) / 2 ELSE 0D END)"""
    return _if_both(f"0.5D * (1 + ({area} - {least!r}D) / ({max_fpr - least!r}D))")


def tpr_at_fpr_agg(target: float) -> Column:
    """Interpolated detection rate at a false-positive budget."""
    t = f"{target}D"
    zero = "named_struct('fpr', 0D, 'tpr', 0D)"
    left = f"coalesce(max(CASE WHEN fpr <= {t} THEN struct(fpr, tpr) END), {zero})"
    right = f"min(CASE WHEN fpr > {t} THEN struct(fpr, tpr) END)"
    slope = f"try_divide({right}.tpr - {left}.tpr, {right}.fpr - {left}.fpr)"
    return _if_both(
        f"CASE WHEN {right} IS NULL THEN {left}.tpr ELSE {left}.tpr + {slope} * ({t} - {left}.fpr) END"
    )


def average_precision_agg() -> Column:
    return _if_both("sum(try_divide(CAST(pos AS DOUBLE), pos_total) * (tps / CAST(tps + fps AS DOUBLE)))")


_EER_GAP = "abs((1D - tpr) - fpr)"
_EER_KEY = f"CASE WHEN corner THEN struct({_EER_GAP} AS gap, -score AS rank) END"


def eer_agg() -> Column:
    """First point, from the highest threshold, where the two error rates are closest."""
    return _if_both(
        f"CASE WHEN min({_EER_KEY}).gap >= 1 THEN 0.5D ELSE min_by((fpr + (1D - tpr)) / 2, {_EER_KEY}) END"
    )


def eer_threshold_agg() -> Column:
    return _if_both(
        f"CASE WHEN min({_EER_KEY}).gap >= 1 THEN double('infinity') ELSE min_by(score, {_EER_KEY}) END"
    )


def youden_threshold_agg() -> Column:
    best = "max(CASE WHEN corner THEN struct(tpr - fpr AS j, score AS t) END)"
    return F.expr(f"CASE WHEN {best}.j > 0 THEN {best}.t ELSE double('infinity') END")


def delong_variance_agg() -> Column:
    """Variance of the AUC from placement values, which midranks reduce to.

    A positive's placement is the share of negatives below it, ties half; likewise a
    negative's is the share of positives above it.
    """
    v_pos = "try_divide(neg_total - neg_before - neg * 0.5D, CAST(neg_total AS DOUBLE))"
    v_neg = "try_divide(pos_before + pos * 0.5D, CAST(pos_total AS DOUBLE))"

    def part(v: str, w: str) -> str:
        n = f"max({w}_total)"
        centred = f"sum({w} * {v} * {v}) - sum({w} * {v}) * sum({w} * {v}) / {n}"
        return f"try_divide(greatest({centred}, 0D), CAST({n} - 1 AS DOUBLE) * {n})"

    return _if_both(f"{part(v_pos, 'pos')} + {part(v_neg, 'neg')}")


def counts_agg(threshold: Column) -> list[Column]:
    hit = F.col("score") >= threshold
    return [
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
    ]


#: Metrics that a score table answers with one aggregate, by name. New ones may be
#: registered; each is a function without arguments that returns an aggregate column.
METRICS: dict[str, Callable[[], Column]] = {
    "auc": auc_agg,
    "ap": average_precision_agg,
    "eer": eer_agg,
    "pauc10": lambda: partial_auc_agg(0.1),
    "tpr_at_1fpr": lambda: tpr_at_fpr_agg(0.01),
    "tpr_at_5fpr": lambda: tpr_at_fpr_agg(0.05),
    "tpr_at_10fpr": lambda: tpr_at_fpr_agg(0.10),
}


def register_metric(name: str, fn: Callable[[], Column]) -> None:
    METRICS[name] = fn


def summarize(table: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    keys = list(by) or [ALL]
    return table.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]).drop(*gone(by))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, auc=auc_agg())


def eer(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, eer=eer_agg(), threshold=eer_threshold_agg())


def partial_auc(df, label: str, score: str, by: Sequence[str] = (), max_fpr: float = 0.1) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, partial_auc=partial_auc_agg(max_fpr))


def tpr_at_fpr(df, label: str, score: str, target: float, by: Sequence[str] = ()) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, tpr=tpr_at_fpr_agg(target))


def average_precision(df, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, ap=average_precision_agg())


def delong(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return summarize(score_table(df, label, score, by), by, auc=auc_agg(), var=delong_variance_agg())


def novelty_auroc(inside: DataFrame, outside: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """How well a novelty score separates familiar rows from new ones."""
    cols = [*by, score]
    both = inside.select(*cols, F.lit(0).alias("_new")).unionByName(outside.select(*cols, F.lit(1).alias("_new")))
    return auc(both, "_new", score, by)


# --------------------------------------------------------------------------
# intervals and tests
# --------------------------------------------------------------------------
def logit_interval(a: Column, var: Column, alpha: float) -> tuple[Column, Column]:
    """Interval on the log-odds scale, which stays inside [0, 1]."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    centre = F.log(a / (F.lit(1.0) - a + TINY) + TINY)
    half = F.sqrt(var) / (a * (F.lit(1.0) - a) + TINY) * z
    return (
        F.lit(1.0) / (F.lit(1.0) + F.exp(-(centre - half))),
        F.lit(1.0) / (F.lit(1.0) + F.exp(-(centre + half))),
    )


def with_interval(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``auc_lo``/``auc_hi`` to rows of (auc, var).

    Zero variance means that every positive beats the same share of negatives; no
    resample can move the AUC then, so the interval is the point. Where the variance
    is undefined (one row of a class) or the AUC touches 0 or 1, the bounds stay null
    and ``needs_bootstrap`` is set.
    """
    a, var = F.col("auc"), F.col("var")
    lo, hi = logit_interval(a, var, alpha)
    fixed = var <= 0
    open_ended = a.isNotNull() & (var.isNull() | (~fixed & ((a >= 1 - 1e-9) | (a <= 1e-9))))
    return stats.withColumns(
        {
            "auc_lo": F.when(fixed, a).when(open_ended, None).otherwise(lo),
            "auc_hi": F.when(fixed, a).when(open_ended, None).otherwise(hi),
            "needs_bootstrap": F.coalesce(open_ended, F.lit(False)),
        }
    )


def delong_ci(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    alpha: float = 0.05,
    row_id: str | None = None,
    n_boot: int = 1000,
) -> DataFrame:
    """AUC with an analytic interval; groups it cannot serve are resampled.

    Only rows of those groups reach the bootstrap, and only if ``row_id`` is given.
    """
    data, keys = keyed(df, by)
    stats = with_interval(delong(data, label, score, keys), alpha)
    if row_id is None:
        return stats.drop("var", "needs_bootstrap", *gone(by))
    rest = stats.where("needs_bootstrap").select(*keys)
    boot = bootstrap_ci(data.join(rest, keys, "left_semi"), "auc", label, score, row_id, n_boot, alpha, by=keys)
    boot = boot.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return (
        stats.join(boot, keys, "left")
        .withColumns({"auc_lo": F.coalesce("auc_lo", "_lo"), "auc_hi": F.coalesce("auc_hi", "_hi")})
        .drop("var", "needs_bootstrap", "_lo", "_hi", *gone(by))
    )


#: A metric by name, or any function ``fn(y, s)`` of the labels and scores of rows.
Metric = str | Callable


def _name(metric: Metric) -> str:
    return metric if isinstance(metric, str) else getattr(metric, "__name__", "metric").strip("<>")


def bootstrap_values(
    df: DataFrame,
    metrics: Sequence[Metric],
    label: str,
    score: str,
    row_id: str,
    n_boot: int,
    seed: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per (group, replicate), with a column per metric.

    A cell, that is rows of one group, score and label, is drawn as Poisson(its count) by
    the hash of its smallest row id. The AUC is folded over all cells in order; other
    metrics see the curve of a group. Groups of more than ``bootstrap.CELLS`` cells, and
    metrics that are registered as aggregates only, go through the score table. A
    function ``fn(y, s)`` gets a whole replicate of its group, whatever its size.
    """
    data, keys = keyed(df, by)
    cells = bootstrap.cells_of(data, keys, label, [score], row_id, seed)
    return _values(cells, keys, metrics, score, n_boot).where("replicate >= 0").drop(*gone(by))


def _values(cells: DataFrame, keys: list[str], metrics: Sequence[Metric], score: str, n_boot: int) -> DataFrame:
    """``bootstrap_values`` of cells; where functions were asked for, replicate -1 has their point values."""
    if list(metrics) == ["auc"]:
        return bootstrap.auc_replicates(cells, keys, score, n_boot)
    cells = cut(cells, "cells")
    functions = {_name(m): bootstrap.CELL_METRICS.get(m) if isinstance(m, str) else bootstrap.of_rows(m) for m in metrics}

    def summed(some: DataFrame) -> DataFrame:
        names = [*keys, "replicate"]
        table = score_table(bootstrap.exploded(some, n_boot), "y", score, names, weight="_w")
        return summarize(table, names, **{m: METRICS[m]() for m in functions})

    if any(f is None for f in functions.values()):
        return summed(cells)
    held = lambda some: bootstrap.cell_replicates(some, keys, score, functions, n_boot)
    large = cells.groupBy(*keys).count().where(F.col("count") > bootstrap.CELLS).select(*keys)
    if not all(isinstance(m, str) for m in metrics) or large.isEmpty():
        return held(cells)
    few, many = cells.join(large, keys, "left_anti"), cells.join(large, keys, "left_semi")
    return held(few).unionByName(summed(many))


def bootstrap_ci(
    df: DataFrame,
    metric: Metric,
    label: str,
    score: str,
    row_id: str,
    n_boot: int = 2000,
    alpha: float = 0.05,
    seed: int = 0,
    by: Sequence[str] = (),
    min_valid: int = 50,
) -> DataFrame:
    """Percentile interval of a metric by name, or of any function ``fn(y, s)``.

    Replicates with one class give null and are left out; fewer than ``min_valid``
    leave the bounds null.
    """
    data, keys = keyed(df, by)
    name = _name(metric)
    cells = bootstrap.cells_of(data, keys, label, [score], row_id, seed)
    values = _values(cells, keys, [metric], score, n_boot)
    if isinstance(metric, str):
        point = summarize(score_table(data, label, score, keys), keys, point=METRICS[metric]())
    else:
        values = cut(values, "replicates")
        point = values.where("replicate = -1").select(*keys, F.col(name).alias("point"))
    bounds = values.where("replicate >= 0").groupBy(*keys).agg(
        F.count(name).alias("n_valid"),
        F.percentile(name, alpha / 2).alias("lo"),
        F.percentile(name, 1 - alpha / 2).alias("hi"),
    )
    enough = F.col("n_valid") >= min_valid
    return (
        point.join(bounds, keys, "left")
        .withColumns({"lo": F.when(enough, F.col("lo")), "hi": F.when(enough, F.col("hi"))})
        .drop(*gone(by))
    )


def paired_auc(
    df: DataFrame, label: str, s1: str, s2: str, row_id: str, by: Sequence[str] = (), n_boot: int = 200, seed: int = 0
) -> DataFrame:
    """AUC difference of two scorings of the same rows, with a two-sided p-value.

    The covariance of the two AUCs comes from a paired bootstrap: cells are rows of equal
    label and equal scores, and one draw of a cell serves both scorings.
    """
    data, keys = keyed(df, by)
    data = data.where(usable(label, s1) & usable(label, s2))
    one = delong(data, label, s1, keys).toDF(*keys, "a1", "v1")
    two = delong(data, label, s2, keys).toDF(*keys, "a2", "v2")
    cells = cut(bootstrap.cells_of(data, keys, label, [s1, s2], row_id, seed), "cells")
    b1 = bootstrap.auc_replicates(cells, keys, s1, n_boot).withColumnRenamed("auc", "x")
    b2 = bootstrap.auc_replicates(cells, keys, s2, n_boot).withColumnRenamed("auc", "y")
    cov = (
        b1.join(b2, [*keys, "replicate"])
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(*keys)
        .agg(F.when(F.count("x") > 10, F.covar_samp("x", "y")).otherwise(0.0).alias("cov"))
    )
    var = F.greatest(F.col("v1") + F.col("v2") - 2 * F.coalesce("cov", F.lit(0.0)), F.lit(TINY))
    joined = one.join(two, keys).join(cov, keys, "left")
    joined = joined.withColumns({"auc_diff": F.col("a1") - F.col("a2"), "z": (F.col("a1") - F.col("a2")) / F.sqrt(var)})
    return joined.withColumn("p_value", two_sided_p(F.col("z"))).drop("v1", "v2", "cov", *gone(by))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v != v else erfc(abs(v) / sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def exact_half_binomial_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of ``b`` successes in ``b + c`` fair trials."""

    def tail(k: int, n: int) -> float:
        """Twice P(X <= k): the largest term times its falling ratios, while they count.

        Terms fall by k / (n - k + 1) at least and soon faster, so about sqrt(n) of them
        matter, whatever k is.
        """
        if n == 0 or 2 * k >= n:
            return 1.0
        top = lgamma(n + 1) - n * log(2.0) - lgamma(k + 1) - lgamma(n - k + 1)
        total = term = 1.0
        for j in range(k, 0, -1):
            term *= j / (n - j + 1)
            total += term
            if term < 1e-17 * total:
                break
        return min(1.0, 2.0 * exp(top) * total)

    return pd.Series([tail(min(x, y), x + y) for x, y in zip(b, c)])


def mcnemar(df: DataFrame, label: str, p1: str, p2: str, by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts of two binary predictions and their exact p-value."""
    data, keys = keyed(df, by)
    right1, right2 = F.col(p1) == F.col(label), F.col(p2) == F.col(label)
    return (
        data.groupBy(*keys)
        .agg(F.count(F.when(right1 & ~right2, 1)).alias("b"), F.count(F.when(~right1 & right2, 1)).alias("c"))
        .withColumn("p_value", exact_half_binomial_p("b", "c"))
        .drop(*gone(by))
    )


# --------------------------------------------------------------------------
# thresholds
# --------------------------------------------------------------------------
def threshold_value(df: DataFrame, label: str, score: str, criterion: str = "eer") -> float:
    """The one threshold of an ungrouped validation table, as a number.

    A single value is fetched, so that plans which use it many times hold a literal
    instead of the whole validation plan.
    """
    return float(threshold(df, label, score, criterion).first()["threshold"])


def threshold(
    df: DataFrame, label: str, score: str, criterion: str = "eer", by: Sequence[str] = ()
) -> DataFrame:
    """Decision threshold per group; 0.5 where a group has one class.

    Pass validation rows: nothing else in the library derives a threshold.
    """
    if criterion not in ("eer", "youden", "f1"):
        raise ValueError(f"criterion must be eer, youden or f1, got {criterion!r}")
    if criterion == "f1":
        return _f1_threshold(df, label, score, by)
    pick = eer_threshold_agg() if criterion == "eer" else youden_threshold_agg()
    pick = F.when(both_classes(), pick).otherwise(0.5)
    return summarize(score_table(df, label, score, by), by, threshold=pick)


def _f1_threshold(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Best F1 over scores rounded to four decimals, lowest threshold on ties.

    Rounding may lift a threshold above some of its own scores, so each rounded value
    keeps the counts at or above it apart from the counts of its whole class.
    """
    data, keys = keyed(df, by)
    s = F.col(score).cast("double")
    t = F.bround(s, 4)
    reach = s >= t
    pts = (
        data.where(s.isNotNull())
        .groupBy(*keys, t.alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) != 1, 1)).alias("neg"),
            F.count(F.when((F.col(label) == 1) & reach, 1)).alias("pos_in"),
            F.count(F.when((F.col(label) != 1) & reach, 1)).alias("neg_in"),
        )
    )
    table = running_sums(pts, keys, [score_level("score", descending=True)], ["-score"], ["pos", "neg"])
    tp = F.col("pos_before") + F.col("pos_in")
    flagged = tp + F.col("neg_before") + F.col("neg_in")
    f1 = F.coalesce(ratio(2.0 * tp, F.col("pos_total") + flagged), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low")))
    pick = F.when((F.max("pos_total") > 0) & (F.max("neg_total") > 0), -best["low"]).otherwise(0.5)
    return summarize(table, by, threshold=pick)
