"""Metric properties, on small tables against plain Python and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchstone.operators import metrics as M
from touchstone.operators import roc
from touchstone.operators.ordered import order_statistic, quantiles


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0, 1).round(2)
    rows = [(f"v{i}", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return rows, spark.createDataFrame(rows, "video_id string, label int, video_score double").cache()


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_curve(rows):
    """(threshold, fpr, tpr) after every distinct score, highest first."""
    p = sum(y for _, y, _ in rows)
    n = len(rows) - p
    out = [(math.inf, 0.0, 0.0)]
    for t in sorted({s for _, _, s in rows}, reverse=True):
        out.append((t, sum(y == 0 and s >= t for _, y, s in rows) / n, sum(y == 1 and s >= t for _, y, s in rows) / p))
    return out


def one(df):
    return df.first().asDict()


def test_auc_matches_pair_counting(noisy):
    rows, df = noisy
    assert one(roc.auc(df, "label", "video_score"))["auc"] == pytest.approx(brute_auc(rows), abs=1e-12)


def test_partial_auc_and_tpr_match_the_curve(noisy):
    rows, df = noisy
    curve = brute_curve(rows)
    fpr, tpr = [c[1] for c in curve], [c[2] for c in curve]
    xs = sorted(set(fpr + [0.1]))
    area = 0.0
    for (x0, y0), (x1, y1) in zip(zip(fpr, tpr), zip(fpr[1:], tpr[1:])):
        if x0 >= 0.1 or x1 == x0:
            continue
        hi = min(x1, 0.1)
        area += (hi - x0) * (y0 + y0 + (y1 - y0) * (hi - x0) / (x1 - x0)) / 2
    least = 0.5 * 0.01
    want = 0.5 * (1 + (area - least) / (0.1 - least))
    assert xs
    assert one(roc.partial_auc(df, "label", "video_score"))["partial_auc"] == pytest.approx(want, abs=1e-9)
    got = one(roc.tpr_at_fpr(df, "label", "video_score", 0.05))["tpr"]
    assert got == pytest.approx(float(np.interp(0.05, fpr, tpr)), abs=1e-9)


def test_corner_points_keep_the_curve(noisy):
    rows, df = noisy
    got = roc.roc_points(df, "label", "video_score").toPandas().sort_values("threshold", ascending=False)
    curve = brute_curve(rows)
    want = np.interp([c[1] for c in curve], got.fpr, got.tpr)
    assert got.iloc[0].threshold == math.inf
    assert np.all(want >= [c[2] for c in curve] - np.float64(1e-9))
    assert len(got) <= len(curve)


def test_perfect_inverted_and_constant(spark):
    make = lambda pairs: spark.createDataFrame(
        [(f"v{i}", y, s) for i, (y, s) in enumerate(pairs)], "video_id string, label int, video_score double"
    )
    perfect = make([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    assert one(roc.auc(perfect, "label", "video_score"))["auc"] == 1.0
    assert one(roc.eer(perfect, "label", "video_score"))["eer"] == 0.0
    ci = one(roc.delong_ci(perfect, "label", "video_score", row_id="video_id"))
    assert (ci["auc_lo"], ci["auc_hi"]) == (1.0, 1.0)
    inverted = make([(1, 0.1), (1, 0.2), (0, 0.8), (0, 0.9)])
    assert one(roc.auc(inverted, "label", "video_score"))["auc"] == 0.0
    flat = make([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)])
    got = one(roc.eer(flat, "label", "video_score"))
    assert got == {"eer": 0.5, "threshold": math.inf}


def test_one_class_is_null_not_an_error(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("b", 1, 0.7)], "video_id string, label int, video_score double")
    row = one(M.evaluate(df, 0.5, "fixed"))
    assert row["auc"] is None and row["eer"] is None and row["n"] == 2 and row["recall"] == 0.5
    assert roc.threshold_value(df, "label", "video_score") == 0.5


def test_single_positive_falls_back_to_the_bootstrap(spark):
    rows = [("p", 1, 0.55)] + [(f"n{i}", 0, i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "video_id string, label int, video_score double")
    got = one(roc.delong_ci(df, "label", "video_score", row_id="video_id", n_boot=200))
    assert got["auc_lo"] is not None and got["auc_lo"] <= got["auc"] <= got["auc_hi"]


def test_bootstrap_brackets_the_point_and_narrows(noisy):
    _, df = noisy
    got = one(roc.bootstrap_ci(df, "auc", "label", "video_score", "video_id", 100))
    assert got["lo"] < got["point"] < got["hi"]
    few = one(roc.bootstrap_ci(df.limit(60), "auc", "label", "video_score", "video_id", 100))
    assert few["hi"] - few["lo"] > got["hi"] - got["lo"]


def test_too_few_replicates_leave_bounds_null(noisy):
    _, df = noisy
    assert one(roc.bootstrap_ci(df, "auc", "label", "video_score", "video_id", 40))["lo"] is None


def test_mcnemar_counts_and_exact_p(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 0), (1, 0, 1), (0, 0, 0)], "label int, p1 int, p2 int")
    assert one(roc.mcnemar(df, "label", "p1", "p2")) == {"b": 1, "c": 1, "p_value": 1.0}
    df = spark.createDataFrame([(1, 1, 0)] * 9 + [(1, 0, 1)], "label int, p1 int, p2 int")
    want = 2 * sum(math.comb(10, k) for k in (0, 1)) / 2**10
    assert one(roc.mcnemar(df, "label", "p1", "p2"))["p_value"] == pytest.approx(want)


def test_mcnemar_of_large_counts_is_quick_and_exact():
    p = lambda b, c: roc.exact_half_binomial_p.func(pd.Series([b]), pd.Series([c]))[0]
    for b, c in ((40, 70), (0, 12), (333, 401)):
        want = 2 * sum(math.comb(b + c, k) for k in range(b + 1)) / 2 ** (b + c)
        assert p(b, c) == p(c, b) == pytest.approx(min(1.0, want), rel=1e-9)
    z = 1.5  # far out, the normal limit holds
    n = 4_000_000_000
    assert p(int(n / 2 - z * math.sqrt(n) / 2), int(n / 2 + z * math.sqrt(n) / 2)) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_rows_without_label_or_score_change_nothing(spark, noisy):
    rows, df = noisy
    odd = [("n1", None, 0.9), ("n2", 1, None), ("n3", 0, float("nan")), ("n4", None, float("nan"))] + [(f"t{i}", None, 0.5) for i in range(40)]
    more = df.union(spark.createDataFrame(odd, df.schema))
    for fn in (
        lambda d: M.evaluate(d, 0.5, "given"),
        lambda d: M.risk_coverage(d, "label", "video_score", 0.5, "video_id").orderBy("coverage"),
        lambda d: roc.auc(d, "label", "video_score"),
    ):
        got, want = fn(more).collect(), fn(df).collect()
        assert len(got) == len(want)
        for a, b in zip(got, want):
            for k, v in b.asDict().items():
                assert a[k] == (pytest.approx(v) if isinstance(v, float) else v), k


def test_paired_test_of_a_scoring_with_itself(noisy):
    _, df = noisy
    got = one(roc.paired_auc(df.withColumn("same", F.col("video_score")), "label", "video_score", "same", "video_id", n_boot=20))
    assert got["auc_diff"] == 0 and got["p_value"] == pytest.approx(1.0)


def test_thresholds(noisy):
    rows, df = noisy
    for name in ("eer", "youden", "f1"):
        assert 0 < roc.threshold_value(df, "label", "video_score", name) < 1
    with pytest.raises(ValueError):
        roc.threshold(df, "label", "video_score", "accuracy")
    best, best_t = -1.0, None
    for t in sorted({round(s, 4) for _, _, s in rows}):
        tp = sum(y == 1 and s >= t for _, y, s in rows)
        f1 = 2 * tp / (sum(y for _, y, _ in rows) + sum(s >= t for _, _, s in rows))
        if f1 > best:
            best, best_t = f1, t
    assert roc.threshold_value(df, "label", "video_score", "f1") == best_t


def test_exactly_one_threshold_source(noisy):
    _, df = noisy
    with pytest.raises(ValueError):
        M.evaluate_split(df)
    with pytest.raises(ValueError):
        M.evaluate_split(df, val=df, threshold=0.5)
    with pytest.raises(ValueError):
        M.evaluate(df, 0.5, "")


def test_calibration_edges(spark):
    # 0.2 sits on an edge of five bins and belongs to the lower one.
    df = spark.createDataFrame([(1, 0.2), (0, 0.0), (1, 1.0)], "label int, p double")
    got = {r["bin"]: r["n"] for r in M.reliability(df, "label", "p", 5).collect()}
    assert got == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}
    assert one(M.ece(df.where("p = 1.0"), "label", "p"))["ece"] == 0.0


def test_reliability_counts_add_up(noisy):
    rows, df = noisy
    assert M.reliability(df, "label", "video_score").agg(F.sum("n")).first()[0] == len(rows)


def test_risk_curve_and_points_agree_on_hot_ties(spark):
    """Half the rows share one confidence; outcomes inside the tie are mixed."""
    rows = [(f"v{i}", i % 2, 0.7 if i % 4 else 0.9) for i in range(200)]
    df = spark.createDataFrame(rows, "video_id string, label int, video_score double")
    curve = M.risk_coverage(df, "label", "video_score", 0.5, "video_id").orderBy("rank").toPandas()
    assert list(curve["rank"]) == list(range(1, 201))
    points = M.risk_at(df, "label", "video_score", 0.5, (0.9, 0.8, 0.705, 0.001), "video_id").collect()
    for r in points:
        want = float(np.interp(r["coverage"], curve.coverage, curve.risk))
        assert r["risk"] == pytest.approx(want, abs=1e-12)


def test_quantiles_and_order_statistics(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 50, 300), np.zeros(100), np.full(50, 1e-12)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = one(quantiles(df, "x", {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}))
    want = np.quantile(x, [0.05, 0.5, 0.95, 0.0, 1.0])
    assert list(got.values()) == pytest.approx(list(want), abs=1e-9)
    assert one(order_statistic(df, "x", "floor(n / 2)"))["value"] == sorted(x)[len(x) // 2]


def test_psi(spark):
    rng = np.random.default_rng(2)
    frame = lambda v: spark.createDataFrame([(float(a),) for a in v], "s double")
    base, same, far = rng.uniform(0, 0.5, 400), rng.uniform(0, 0.5, 400), rng.uniform(0.5, 1, 400)

    def brute(b, v):
        edges = np.linspace(0, 1, 11)
        hb, hv = np.histogram(b, edges)[0] + 1e-6, np.histogram(v, edges)[0] + 1e-6
        hb, hv = hb / (len(b) + 1e-5), hv / (len(v) + 1e-5)
        return float(np.sum((hv - hb) * np.log(hv / hb)))

    for live in (same, far, [1.0] * 20, [0.3] * 20):
        assert one(M.psi(frame(base), frame(live), "s"))["psi"] == pytest.approx(brute(base, live), abs=1e-9)
    assert one(M.psi(frame(base), frame(same[:9]), "s"))["psi"] is None


def test_run_report_uses_only_the_validation_threshold(spark, noisy):
    _, df = noisy
    runs = df.withColumn("split", F.when(F.crc32(F.col("video_id")) % 2 == 0, "val").otherwise("test"))
    flipped = runs.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    t = {r["name"]: r["threshold"] for r in M.evaluate_run(flipped).collect()}
    assert t["val"] == t["test"] == roc.threshold_value(runs.where("split = 'val'"), "label", "video_score")


def test_gap_ignores_slices_and_orphans(spark):
    df = spark.createDataFrame(
        [("a", "val", 0.95), ("a", "x", 0.7), ("a", "y", 0.8), ("a", "x/m=1", 0.1), ("b", "x", 0.9)],
        "exp string, split string, auc double",
    )
    got = [(r["exp"], r["test_set"], r["gap"]) for r in M.cross_gap(df).collect()]
    assert got == [("a", "x", 0.25), ("a", "y", 0.15)]
