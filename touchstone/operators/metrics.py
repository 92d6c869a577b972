"""Decision, calibration and selective-risk metrics, and full reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction
from ..functions.numeric import c, clip, closed_open_bin, half_open_bin, half_up, ratio
from . import roc
from .ordered import gone, hash_level, keyed, running_sums, score_level


def with_threshold(df: DataFrame, thr, by: Sequence[str] = (), name: str = "threshold") -> DataFrame:
    """Attach a threshold: a number, a column, or a table from ``roc.threshold``.

    An ungrouped threshold table is one row by construction, which is what makes its
    broadcast safe at any scale; a grouped one is joined on its keys.
    """
    if isinstance(thr, DataFrame):
        if by:
            return df.join(thr.withColumnRenamed("threshold", name), list(by))
        one = thr.groupBy().agg(F.max("threshold").alias(name))
        return df.crossJoin(F.broadcast(one))
    return df.withColumn(name, F.lit(thr) if isinstance(thr, (int, float)) else c(thr))


# --------------------------------------------------------------------------
# decisions
# --------------------------------------------------------------------------
def decision_columns() -> dict[str, Column]:
    """Ratios from tp/fp/fn/tn; an empty denominator counts as zero."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
    }


def decisions(df: DataFrame, label: str, score: str, thr, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the ratios read off them; truth is 0, 1 in row order."""
    data, keys = keyed(df, by)
    data = with_threshold(data, thr, ())
    hit, truth = F.col(score) >= F.col("threshold"), F.col(label) == 1
    counted = data.groupBy(*keys).agg(
        F.count(F.when(truth & hit, 1)).alias("tp"),
        F.count(F.when(~truth & hit, 1)).alias("fp"),
        F.count(F.when(truth & ~hit, 1)).alias("fn"),
        F.count(F.when(~truth & ~hit, 1)).alias("tn"),
    )
    return counted.withColumns(decision_columns()).drop(*gone(by))


# --------------------------------------------------------------------------
# calibration
# --------------------------------------------------------------------------
def reliability_bins(
    df: DataFrame, label: str, prob: str, n_bins: int, by: Sequence[str], *more: Column
) -> DataFrame:
    """Counts per occupied bin; rows outside [0, 1] fall in the null bin."""
    miss = clip(prob, 0.0, 1.0) - F.col(label)
    return df.groupBy(*by, half_open_bin(F.col(prob), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(label).cast("double")).alias("hits"),
        F.sum(F.col(prob).cast("double")).alias("mass"),
        F.sum(miss * miss).alias("sq"),
        *more,
    )


def calibration_aggs(min_rows: int = 10) -> dict[str, Column]:
    gap = F.abs(ratio("hits", "n") - ratio("mass", "n"))
    inside = F.col("bin").isNotNull()
    return {
        "ece": F.sum(F.when(inside, F.col("n") * gap).otherwise(0.0)) / F.sum("n"),
        "mce": F.coalesce(F.max(F.when(inside & (F.col("n") >= min_rows), gap)), F.lit(0.0)),
        "brier": F.sum("sq") / F.sum("n"),
    }


def calibration(df: DataFrame, label: str, prob: str, n_bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """ECE, MCE and Brier score in one pass over per-bin counts."""
    data, keys = keyed(df, by)
    bins = reliability_bins(data, label, prob, n_bins, keys)
    return bins.groupBy(*keys).agg(*[a.alias(k) for k, a in calibration_aggs().items()]).drop(*gone(by))


def ece(df, label: str, prob: str, n_bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    return calibration(df, label, prob, n_bins, by).select(*by, "ece")


def mce(df, label: str, prob: str, n_bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    return calibration(df, label, prob, n_bins, by).select(*by, "mce")


def brier(df, label: str, prob: str, by: Sequence[str] = ()) -> DataFrame:
    return calibration(df, label, prob, 15, by).select(*by, "brier")


def reliability(df: DataFrame, label: str, prob: str, n_bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Every bin of the diagram, empty ones included: centre, observed rate, count."""
    data, keys = keyed(df, by)
    seen = reliability_bins(data, label, prob, n_bins, keys)
    frame = (
        seen.select(*keys)
        .distinct()
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    )
    step = 1.0 / n_bins
    return (
        frame.join(seen, [*keys, "bin"], "left")
        .select(
            *keys,
            "bin",
            ((F.col("bin") * step + (F.col("bin") + 1) * step) / 2).alias("centre"),
            ratio("hits", "n").alias("observed"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .drop(*gone(by))
    )


# --------------------------------------------------------------------------
# selective prediction
# --------------------------------------------------------------------------
def _confidence(df: DataFrame, label: str, prob: str, thr, keep: Sequence[str]) -> DataFrame:
    df = with_threshold(df.where(roc.usable(label, prob)), thr, (), "_thr")
    right = (F.col(prob) >= F.col("_thr")).cast("int") == F.col(label).cast("int")
    return df.select(
        *keep,
        F.abs(F.col(prob).cast("double") - F.col("_thr")).alias("conf"),
        right.cast("bigint").alias("right"),
        F.lit(1).cast("bigint").alias("one"),
    )


def risk_coverage(df: DataFrame, label: str, prob: str, thr, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """The whole curve, one row per input row, most confident first.

    Equal confidences are ordered by hashed id, then id: a fixed order that also
    splits a hot tie over many buckets.
    """
    data, keys = keyed(df, by)
    data = _confidence(data, label, prob, thr, [*keys, row_id])
    data = data.withColumn("_u", hash_fraction(row_id))
    curve = running_sums(
        data,
        keys,
        [score_level("conf", descending=True), "-conf", hash_level("_u")],
        ["_u", f"`{row_id}`"],
        ["one", "right"],
    )
    rank = F.col("one_before") + 1
    return curve.select(
        *keys,
        row_id,
        rank.alias("rank"),
        ratio(rank, "one_total").alias("coverage"),
        (F.lit(1.0) - ratio(F.col("right_before") + F.col("right"), rank)).alias("risk"),
    ).drop(*gone(by))


def risk_at(
    df: DataFrame,
    label: str,
    prob: str,
    thr,
    coverages: Sequence[float],
    row_id: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Interpolated selective risk at each coverage, without ranking single rows.

    Counts per distinct confidence locate the two ranks each coverage lies between.
    Only when such a rank falls inside a tie of mixed outcomes are that tie's rows
    ordered (by hashed id, as in ``risk_coverage``).
    """
    data, keys = keyed(df, by)
    data = _confidence(data, label, prob, thr, [*keys, row_id])
    ties = data.groupBy(*keys, "conf").agg(F.sum("one").alias("one"), F.sum("right").alias("right"))
    return _risk_from_ties(ties, data, keys, coverages, row_id).drop(*gone(by))


def _risk_from_ties(
    ties: DataFrame, data: DataFrame, keys: Sequence[str], coverages: Sequence[float], row_id: str
) -> DataFrame:
    """``risk_at`` from counts per confidence; ``data`` is read for mixed ties alone."""
    ties = running_sums(
        ties, keys, [score_level("conf", descending=True)], ["-conf"], ["one", "right"]
    )

    wanted = []
    for cov in coverages:
        guess = f"CAST(floor(one_total * {cov}D) AS BIGINT)"
        low = f"""greatest(CASE WHEN ({guess} + 1) / one_total <= {cov}D THEN {guess} + 1
            WHEN {guess} / one_total > {cov}D THEN {guess} - 1 ELSE {guess} END, 1L)"""
        wanted.append(f"named_struct('cov', {cov}D, 'side', 'lo', 'k', {low})")
        wanted.append(f"named_struct('cov', {cov}D, 'side', 'hi', 'k', least({low} + 1, one_total))")
    hits = ties.selectExpr("*", f"inline(array({', '.join(wanted)}))")
    hits = hits.where("k > one_before AND k <= one_before + one").selectExpr("*", "k - one_before AS j")
    mixed = (F.col("j") < F.col("one")) & (F.col("right") > 0) & (F.col("right") < F.col("one"))
    asked = hits.where(mixed).select(*keys, "conf").distinct()
    ordered = data.join(asked, [*keys, "conf"], "left_semi").withColumn("_u", hash_fraction(row_id))
    ordered = running_sums(
        ordered.select(*keys, "conf", "_u", row_id, "one", F.col("right").alias("ok")),
        [*keys, "conf"],
        [hash_level("_u")],
        ["_u", f"`{row_id}`"],
        ["one", "ok"],
    ).select(*keys, "conf", (F.col("one_before") + 1).alias("j"), (F.col("ok_before") + F.col("ok")).alias("ok"))
    whole = F.when(F.col("right") == 0, 0).when(F.col("right") == F.col("one"), F.col("j")).otherwise(F.col("right"))
    risks = hits.join(ordered, [*keys, "conf", "j"], "left").withColumn(
        "risk",
        F.lit(1.0) - ratio(F.col("right_before") + F.when(mixed, F.col("ok")).otherwise(whole), "k"),
    )
    pick = lambda side, v: f"max(CASE WHEN side = '{side}' THEN {v} END)"
    r0, r1, k0, k1 = pick("lo", "risk"), pick("hi", "risk"), pick("lo", "k"), pick("hi", "k")
    n = "max(one_total)"
    value = f"""CASE WHEN coverage <= {k0} / {n} OR {k0} = {k1} THEN {r0}
        ELSE {r0} + ({r1} - {r0}) / ({k1} / {n} - {k0} / {n}) * (coverage - {k0} / {n}) END"""
    return risks.withColumnRenamed("cov", "coverage").groupBy(*keys, "coverage").agg(F.expr(value).alias("risk"))


def abstain_rate(df: DataFrame, abstain: str, by: Sequence[str] = ()) -> DataFrame:
    data, keys = keyed(df, by)
    return data.groupBy(*keys).agg(F.avg(F.col(abstain).cast("double")).alias("abstain_rate")).drop(*gone(by))


# --------------------------------------------------------------------------
# full reports
# --------------------------------------------------------------------------
def evaluate(
    df: DataFrame,
    thr,
    thr_source: str,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "video_score",
    prob: str | None = None,
    abstain: str | None = None,
    row_id: str = "video_id",
    n_boot: int = 0,
    alpha: float = 0.05,
) -> DataFrame:
    """One full metric row per group.

    Ranking and decisions use ``score``; calibration and selective risk use ``prob``
    (``score`` if absent). ``thr_source`` says where the threshold came from and is
    kept in every row. With ``n_boot`` the interval is a bootstrap one.
    """
    if not thr_source:
        raise ValueError("thr_source must say where the threshold came from")
    prob = prob or score
    data, keys = keyed(df, by)
    # Every branch below sees the same rows: those with a label and a number as score.
    data = with_threshold(data.where(roc.usable(label, score)), thr, ())
    used = list(dict.fromkeys([*keys, "threshold", label, score, prob, row_id] + ([abstain] if abstain else [])))
    data = data.select(*used)

    # Counts per distinct (score, prob) are all that ranking, calibration and risk need:
    # the rows are read and shuffled once, and every branch below starts from here.
    group = [*keys, "threshold"]
    held = f"CAST(`{abstain}` AS INT)" if abstain else "0"
    base = data.groupBy(
        *group,
        F.col(score).cast("double").alias("score"),
        *([F.col(prob).cast("double").alias("prob")] if prob != score else []),
    ).agg(
        F.expr(f"count(CASE WHEN `{label}` = 1 THEN 1 END) AS pos"),
        F.expr(f"count(CASE WHEN `{label}` <> 1 THEN 1 END) AS neg"),
        F.expr(f"sum({held}) AS held"),
    )
    if prob == score:
        base = base.withColumn("prob", F.col("score"))
        pts = base.select(*group, "score", "pos", "neg")
    else:
        pts = base.groupBy(*group, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = roc.curve_table(pts, group)
    aggs = {name: roc.METRICS[name]() for name in
            ("auc", "pauc10", "ap", "eer", "tpr_at_1fpr", "tpr_at_5fpr", "tpr_at_10fpr")}
    ranked = table.groupBy(*keys, "threshold").agg(
        F.max(F.col("pos_total") + F.col("neg_total")).alias("n"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        *[a.alias(k) for k, a in aggs.items()],
        roc.delong_variance_agg().alias("var"),
        *roc.counts_agg(F.col("threshold")),
    )
    ranked = roc.with_interval(ranked, alpha).withColumns(decision_columns())
    if n_boot:
        boot = roc.bootstrap_ci(data, "auc", label, score, row_id, n_boot, alpha, by=keys)
        boot = boot.select(*keys, "lo", "hi")
        ranked = ranked.join(boot, keys, "left").withColumns({"auc_lo": F.col("lo"), "auc_hi": F.col("hi")})
        ranked = ranked.drop("lo", "hi")

    p = "least(greatest(prob, 0D), 1D)"
    fit = base.groupBy(*keys, half_open_bin(F.col("prob"), 15).alias("bin")).agg(
        F.expr("sum(pos + neg) AS n"),
        F.expr("CAST(sum(pos) AS DOUBLE) AS hits"),
        F.expr("sum((pos + neg) * prob) AS mass"),
        F.expr(f"sum(pos * (1 - {p}) * (1 - {p}) + neg * {p} * {p}) AS sq"),
        F.expr("sum(held) AS held"),
    )
    fit = fit.groupBy(*keys).agg(
        *[a.alias(k) for k, a in calibration_aggs().items()],
        *([ratio(F.sum("held"), F.sum("n")).alias("abstain_rate")] if abstain else []),
    )
    sure = "abs(prob - threshold)"
    ties = base.groupBy(*group, F.expr(sure).alias("conf")).agg(
        F.expr("sum(pos + neg) AS one"), F.expr("sum(CASE WHEN prob >= threshold THEN pos ELSE neg END) AS right")
    )
    rows = _confidence(data, label, prob, F.col("threshold"), [*group, row_id])
    risk = _risk_from_ties(ties, rows, group, (0.9, 0.8, 0.7), row_id)
    risk = risk.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("coverage") == cov, F.col("risk"))).alias(f"risk_at_{int(cov * 100)}cov")
            for cov in (0.9, 0.8, 0.7)
        ]
    )
    out = ranked.join(fit, keys, "left").join(risk, keys, "left")
    if not abstain:
        out = out.withColumn("abstain_rate", F.lit(None).cast("double"))
    confusion = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    return out.withColumns({"confusion": confusion, "threshold_source": F.lit(thr_source)}).drop(
        "var", "needs_bootstrap", *gone(by)
    )


def breakdown(df: DataFrame, keys: Sequence[str], base: Column) -> DataFrame:
    """Each row once under its split and once per ``split/key=value``.

    The copies are made before the map-side combine, so only (group, score) counts
    are shuffled, not the copies.
    """
    names = [base] + [
        F.when(F.col(k).isNotNull(), F.concat(base, F.lit(f"/{k}="), F.col(k).cast("string"))) for k in keys
    ]
    return df.withColumn("name", F.explode(F.array_compact(F.array(*names))))


def evaluate_run(
    preds: DataFrame,
    val: str = "val",
    keys: Sequence[str] = (),
    min_n: int = 10,
    split: str = "split",
    prob: str | None = None,
    decide_on: str = "video_score",
    n_boot: int = 0,
) -> DataFrame:
    """Every split, and every slice of it, against the validation threshold.

    The threshold is taken from rows of ``val`` on ``prob`` and from nowhere else.
    ``decide_on`` is the column it is then applied to. Slices under ``min_n`` rows are
    left out; whole splits are always reported.
    """
    prob = prob or decide_on
    thr = roc.threshold_value(preds.where(F.col(split) == val), "label", prob)
    expanded = breakdown(preds, keys, F.col(split))
    abstain = "abstain" if "abstain" in preds.columns else None
    rows = evaluate(expanded, thr, f"EER on {val}, column={prob}", ["name"], score=decide_on, prob=prob,
                    abstain=abstain, n_boot=n_boot)
    return rows.where((F.instr("name", "/") == 0) | (F.col("n") >= min_n))


def evaluate_split(
    test: DataFrame,
    val: DataFrame | None = None,
    threshold: float | None = None,
    key: str | None = None,
    name: str = "all",
    n_boot: int = 0,
) -> DataFrame:
    """One table of predictions, with exactly one sanctioned threshold source."""
    if (val is None) == (threshold is None):
        raise ValueError("give exactly one of val rows or a threshold derived from them")
    if key is not None and key not in test.columns:
        raise ValueError(f"{key!r} is not one of {sorted(test.columns)}")
    thr = roc.threshold_value(val, "label", "video_score") if val is not None else float(threshold)
    source = "EER on source val" if val is not None else "given by caller"
    expanded = breakdown(test, [key] if key else [], F.lit(name))
    return evaluate(
        expanded,
        thr,
        source,
        ["name"],
        prob="calibrated_prob" if "calibrated_prob" in test.columns else None,
        abstain="abstain" if "abstain" in test.columns else None,
        n_boot=n_boot,
    )


# --------------------------------------------------------------------------
# drift
# --------------------------------------------------------------------------
def psi(base: DataFrame, live: DataFrame, col: str, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Population stability index per group; null if either side has under ten rows."""
    b, keys = keyed(base, by)
    v, _ = keyed(live, by)
    side = lambda df, name: df.where(F.col(col).isNotNull()).select(
        *keys, closed_open_bin(F.col(col), n_bins).alias("bin"), F.lit(name).alias("side")
    )
    counts = side(b, "base").unionByName(side(v, "live")).groupBy(*keys, "bin").agg(
        F.count(F.when(F.col("side") == "base", 1)).alias("nb"),
        F.count(F.when(F.col("side") == "live", 1)).alias("nl"),
    )
    totals = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("nb", "nl")))).alias("m"),
        F.sum("nb").alias("tb"),
        F.sum("nl").alias("tl"),
    )
    return totals.select(*keys, psi_from_counts("m", "tb", "tl", n_bins).alias("psi")).drop(*gone(by))


def psi_from_counts(m: str, tb: str, tl: str, n_bins: int) -> Column:
    """PSI from a map bin -> (nb, nl); at most ``n_bins`` entries, so it stays small."""
    eps = 1e-6

    def term(i: int) -> Column:
        e = F.try_element_at(F.col(m), F.lit(i))
        b = (F.coalesce(e["nb"], F.lit(0)) + eps) / (F.col(tb) + eps * n_bins)
        v = (F.coalesce(e["nl"], F.lit(0)) + eps) / (F.col(tl) + eps * n_bins)
        return (v - b) * F.log(v / b)

    total = term(0)
    for i in range(1, n_bins):
        total = total + term(i)
    return F.when((F.col(tb) >= 10) & (F.col(tl) >= 10), total)


def cross_gap(df: DataFrame, base: str = "val", exp: str = "exp", split: str = "split", auc: str = "auc") -> DataFrame:
    """In-dataset AUC minus every other split's, per experiment, widest gap first.

    Slices (names with ``/``) and undefined AUCs take no part; experiments without the
    base split are dropped.
    """
    whole = df.where((F.instr(split, "/") == 0) & F.col(auc).isNotNull())
    inside = whole.where(F.col(split) == base).select(exp, F.col(auc).alias("_in"))
    return (
        whole.where(F.col(split) != base)
        .join(inside, exp)
        .select(
            exp,
            F.col(split).alias("test_set"),
            half_up("_in", 4).alias("in_dataset_auc"),
            half_up(auc, 4).alias("cross_dataset_auc"),
            half_up(F.col("_in") - F.col(auc), 4).alias("gap"),
            *(["n_seeds"] if "n_seeds" in df.columns else []),
        )
        .orderBy(F.desc("gap"), exp, "test_set")
    )
