"""Queries over prediction tables: ROC metrics, calibration, selective risk, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import metrics as M
from ..operators import bootstrap, roc
from .fixtures import H, R
from .registry import query

DS = ["dataset"]


def r6(df, *cols):
    return df.withColumns({k: half_up(k, 6) for k in cols})


def roc_sql(src: str, by: str, score: str = "video_score", label: str = "label", pre: str = "") -> str:
    """CTEs ``{pre}pts`` and ``{pre}t``: the ROC table of ``src`` grouped by ``by``."""
    part = f"PARTITION BY {by}"
    above = f"OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""{pre}pts AS (SELECT {by}, {score} AS score, sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END)::BIGINT AS pos,
          sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END)::BIGINT AS neg FROM {src} GROUP BY {by}, {score}),
      {pre}r AS (SELECT *, coalesce(sum(pos) {above}, 0)::BIGINT AS pb, coalesce(sum(neg) {above}, 0)::BIGINT AS nb,
          (sum(pos) OVER ({part}))::BIGINT AS p, (sum(neg) OVER ({part}))::BIGINT AS n,
          lead(pos) OVER ({part} ORDER BY score DESC) AS np, lead(neg) OVER ({part} ORDER BY score DESC) AS nn FROM {pre}pts),
      {pre}t AS (SELECT *, pb + pos AS tps, nb + neg AS fps, pb / nullif(p, 0)::DOUBLE AS tpr0, nb / nullif(n, 0)::DOUBLE AS fpr0,
          (pb + pos) / nullif(p, 0)::DOUBLE AS tpr, (nb + neg) / nullif(n, 0)::DOUBLE AS fpr,
          (pb + nb = 0 OR np IS NULL OR np <> pos OR nn <> neg) AS corner FROM {pre}r)"""


AUC = "sum(neg * (pb + pos * 0.5::DOUBLE)) / nullif(max(p)::DOUBLE * max(n), 0)"
BOTH = "max(p) > 0 AND max(n) > 0"


def pauc(m: float) -> str:
    return f"""CASE WHEN {BOTH} THEN 0.5::DOUBLE * (1 + (sum(CASE WHEN fpr <= {m}::DOUBLE THEN (fpr - fpr0) * (tpr0 + tpr) / 2
        WHEN fpr0 < {m}::DOUBLE THEN ({m}::DOUBLE - fpr0) * (tpr0 + (tpr0 + (tpr - tpr0) * ({m}::DOUBLE - fpr0) / (fpr - fpr0))) / 2
        ELSE 0 END) - {0.5 * m * m}::DOUBLE) / ({m}::DOUBLE - {0.5 * m * m}::DOUBLE)) END"""


def tpr_at(m: float) -> str:
    left = f"coalesce(max(CASE WHEN fpr <= {m}::DOUBLE THEN {{'f': fpr, 't': tpr}} END), {{'f': 0.0::DOUBLE, 't': 0.0::DOUBLE}})"
    right = f"min(CASE WHEN fpr > {m}::DOUBLE THEN {{'f': fpr, 't': tpr}} END)"
    return f"""CASE WHEN {BOTH} THEN CASE WHEN {right} IS NULL THEN ({left}).t ELSE
        ({left}).t + (({right}).t - ({left}).t) / (({right}).f - ({left}).f) * ({m}::DOUBLE - ({left}).f) END END"""


AP = f"CASE WHEN {BOTH} THEN sum(pos / nullif(p, 0)::DOUBLE * (tps / (tps + fps)::DOUBLE)) END"
GAP = "abs((1.0::DOUBLE - tpr) - fpr)"
EER_KEY = f"(CASE WHEN corner THEN {{'g': {GAP}, 's': -score}} END)"
EER = f"""CASE WHEN {BOTH} THEN CASE WHEN min({EER_KEY}).g >= 1 THEN 0.5::DOUBLE
      ELSE arg_min((fpr + (1.0::DOUBLE - tpr)) / 2, {EER_KEY}) END END"""
EER_THR = f"""CASE WHEN {BOTH} THEN CASE WHEN min({EER_KEY}).g >= 1 THEN 'infinity'::DOUBLE
      ELSE arg_min(score, {EER_KEY}) END END"""
VPOS = "((n - nb - neg * 0.5::DOUBLE) / nullif(n, 0)::DOUBLE)"
VNEG = "((pb + pos * 0.5::DOUBLE) / nullif(p, 0)::DOUBLE)"


def _var(v: str, w: str, tot: str) -> str:
    s = f"sum({w} * {v} * {v}) - sum({w} * {v}) * sum({w} * {v}) / max({tot})"
    return f"greatest({s}, 0) / nullif((max({tot}) - 1)::DOUBLE * max({tot}), 0)"


VAR = f"CASE WHEN {BOTH} THEN {_var(VPOS, 'pos', 'p')} + {_var(VNEG, 'neg', 'n')} END"


def bin15(x: str, n: int = 15) -> str:
    """Bin index for (lo, hi] edges; the first bin is closed."""
    edges = ", ".join(f"{i} * {1.0 / n!r}::DOUBLE" for i in range(1, n))
    return f"(CASE WHEN {x} >= 0 AND {x} <= 1 THEN len(list_filter([{edges}], lambda e: {x} > e)) END)"


@query("m1_roc_points", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, score AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM t WHERE corner
   UNION ALL SELECT DISTINCT dataset, 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t""")
def _(t):
    return roc.roc_points(t.preds, "label", "video_score", DS).withColumns(
        {"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)}
    )


@query("m2_auc", "preds", f"""WITH {roc_sql('preds', 'forgery_method')}
   SELECT forgery_method, {R(AUC, 6)} AS auc FROM t GROUP BY forgery_method""")
def _(t):
    return r6(roc.auc(t.preds, "label", "video_score", ["forgery_method"]), "auc")


@query("m2_auc_lineitem", "preds_li", f"""WITH {roc_sql('preds_li', 'grp', 'score')}
   SELECT grp, {R(AUC, 6)} AS auc, {R(AP, 6)} AS ap FROM t GROUP BY grp""")
def _(t):
    table = roc.score_table(t.preds_li, "label", "score", ["grp"])
    return r6(roc.summarize(table, ["grp"], auc=roc.auc_agg(), ap=roc.average_precision_agg()), "auc", "ap")


@query("m3_eer", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, {R(EER, 6)} AS eer, {EER_THR} AS threshold FROM t GROUP BY dataset""")
def _(t):
    return r6(roc.eer(t.preds, "label", "video_score", DS), "eer")


@query("m4_partial_auc", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, {R(pauc(0.1), 6)} AS partial_auc FROM t GROUP BY dataset""")
def _(t):
    return r6(roc.partial_auc(t.preds, "label", "video_score", DS), "partial_auc")


@query("m5_tpr_at_fpr", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, {R(tpr_at(0.01), 6)} AS tpr_at_1fpr, {R(tpr_at(0.05), 6)} AS tpr_at_5fpr,
     {R(tpr_at(0.1), 6)} AS tpr_at_10fpr FROM t GROUP BY dataset""")
def _(t):
    table = roc.score_table(t.preds, "label", "video_score", DS)
    names = ["tpr_at_1fpr", "tpr_at_5fpr", "tpr_at_10fpr"]
    return r6(roc.summarize(table, DS, **{n: roc.METRICS[n]() for n in names}), *names)


@query("m6_average_precision", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, {R(AP, 6)} AS ap FROM t GROUP BY dataset""")
def _(t):
    return r6(roc.average_precision(t.preds, "label", "video_score", DS), "ap")


@query("m7_delong", "preds", f"""WITH {roc_sql('preds', 'dataset')}
   SELECT dataset, {R(AUC, 6)} AS auc, {R(f'1000 * ({VAR})', 6)} AS var_milli FROM t GROUP BY dataset""")
def _(t):
    d = roc.delong(t.preds, "label", "video_score", DS)
    return r6(d.select("dataset", "auc", (F.col("var") * 1000).alias("var_milli")), "auc", "var_milli")


Z95 = 1.9599639845400536
CI_LO = "1 / (1 + exp(-(c - h)))"
CI_HI = "1 / (1 + exp(-(c + h)))"


@query("m8_delong_ci", "preds", f"""WITH {roc_sql('preds', 'dataset')},
   d AS (SELECT dataset, {AUC} AS a, {VAR} AS v FROM t GROUP BY dataset),
   e AS (SELECT *, ln(a / (1.0::DOUBLE - a + 1e-12) + 1e-12) AS c, sqrt(v) / (a * (1.0::DOUBLE - a) + 1e-12) * {Z95}::DOUBLE AS h FROM d)
   SELECT dataset, {R('a', 6)} AS auc, {R(CI_LO, 6)} AS auc_lo, {R(CI_HI, 6)} AS auc_hi FROM e""")
def _(t):
    return r6(roc.delong_ci(t.preds, "label", "video_score", DS, row_id="video_id"), "auc", "auc_lo", "auc_hi")


def _mixed(x: str, src: str, keep: str) -> str:
    """Subqueries that take ``x`` of ``src`` through the mixing steps of a draw; the result is ``x``."""
    steps = [f"xor({x}, {x} >> 16)", f"({x} * {bootstrap.MIX[0]}) % 4294967296", f"xor({x}, {x} >> 13)", f"({x} * {bootstrap.MIX[1]}) % 4294967296", f"xor({x}, {x} >> 16)"]
    for step in steps:
        src = f"(SELECT {keep}, {step} AS {x} FROM {src})"
    return src


def boot_sql(src: str, scores: str, n_boot: int) -> str:
    """CTE ``drawn``: cells of ``src`` with their weight ``w`` in each replicate ``rep``."""
    keep = f"dataset, {scores}, label, n, lo, rep"
    number = f"xor(hi, ((rep * {bootstrap.GOLDEN}) % 4294967296)::UBIGINT) AS x"
    first = _mixed("x", f"(SELECT *, {number} FROM h, (SELECT unnest(range({n_boot})) AS rep))", keep)
    second = _mixed("x", f"(SELECT {keep}, xor(x, lo) AS x FROM {first})", keep)
    # The number of edges up to x; most draws end within the first few.
    weight = "CASE " + " ".join(f"WHEN x < steps[{k + 1}] THEN {k}" for k in range(12)) + " ELSE len(list_filter(steps, lambda s: s <= x)) END"
    return f"""h AS (SELECT dataset, {scores}, label, n, ('0x' || substr(d, 1, 8))::UBIGINT AS hi, ('0x' || substr(d, 9, 8))::UBIGINT AS lo FROM (
      SELECT dataset, {scores}, label, count(*) AS n, sha256('0:' || min(video_id)) AS d FROM {src} GROUP BY ALL)),
   e(n, k, term, total) AS (SELECT DISTINCT n, 0, exp(-n::DOUBLE), exp(-n::DOUBLE) FROM h
      UNION ALL SELECT n, k + 1, term * (n::DOUBLE / (k + 1)), total + term * (n::DOUBLE / (k + 1)) FROM e WHERE total < 1 - 1e-12::DOUBLE),
   edges AS (SELECT n, list(round(total, 12) ORDER BY k) AS steps FROM e GROUP BY n),
   drawn AS (SELECT dataset, {scores}, label, rep, {weight} AS w FROM (SELECT * REPLACE (x / 4294967296.0::DOUBLE AS x) FROM {second}) JOIN edges USING (n))"""


def boot_auc_sql(score: str, name: str) -> str:
    """CTE ``name``: (dataset, rep, auc) of ``drawn`` by one of its scores."""
    reach = lambda way: f"sum(w * label) OVER (PARTITION BY dataset, rep ORDER BY {score} {way} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    # A negative counts positives above it and half of those at its score: the mean of those not below and those above.
    return f"""{name} AS (SELECT dataset, rep, CASE WHEN p * n > 0 THEN (u + p * n) / 2 / (p * n) END AS auc FROM (
      SELECT dataset, rep, sum(w * label)::DOUBLE AS p, sum(w * (1 - label))::DOUBLE AS n, sum(w * (1 - label) * (up - down))::DOUBLE AS u FROM (
        SELECT *, {reach('DESC')} AS up, {reach('ASC')} AS down FROM drawn WHERE w > 0) GROUP BY dataset, rep))"""


def _variance_sql(score: str, pre: str) -> str:
    return f"""{roc_sql('preds_alt', 'dataset', score, pre=pre)},
   {pre}d AS (SELECT dataset, {AUC} AS a, {VAR} AS v FROM {pre}t GROUP BY dataset)"""


#: erfc of ``x`` by the series of exp(x * x) * erf(x), whose terms are all positive.
_TERM = "exp(2 * k * ln(2.0::DOUBLE) + (2 * k + 1) * ln(x) - lgamma(2 * k + 2) + lgamma(k + 1))"
ERFC = f"CASE WHEN x = 0 THEN 1 WHEN x > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(150), lambda k: {_TERM})) END"


@query("m9_paired_auc_test", "preds_alt", f"""WITH RECURSIVE {boot_sql('preds_alt', 'video_score, alt_score', 200)},
   {boot_auc_sql('video_score', 'b1')}, {boot_auc_sql('alt_score', 'b2')},
   {_variance_sql('video_score', 'x')}, {_variance_sql('alt_score', 'y')},
   cov AS (SELECT dataset, CASE WHEN count(*) > 10 THEN covar_samp(b1.auc, b2.auc) ELSE 0 END AS c FROM b1 JOIN b2 USING (dataset, rep)
      WHERE b1.auc IS NOT NULL AND b2.auc IS NOT NULL GROUP BY dataset),
   q AS (SELECT dataset, xd.a AS a1, yd.a AS a2, xd.a - yd.a AS diff, (xd.a - yd.a) / sqrt(greatest(xd.v + yd.v - 2 * coalesce(c, 0), 1e-12)) AS z
      FROM xd JOIN yd USING (dataset) LEFT JOIN cov USING (dataset))
   SELECT dataset, {R('a1', 6)} AS a1, {R('a2', 6)} AS a2, {R('diff', 6)} AS auc_diff, {R('z', 6)} AS z, {R(ERFC, 6)} AS p_value FROM (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM q)""")
def _(t):
    return r6(roc.paired_auc(t.preds_alt, "label", "video_score", "alt_score", "video_id", DS), "a1", "a2", "auc_diff", "z", "p_value")


@query("j9_paired_models", "preds_alt", f"""WITH {roc_sql('preds_alt', 'dataset', 'video_score', pre='x')},
   {roc_sql('preds_alt', 'dataset', 'alt_score', pre='y')},
   a AS (SELECT dataset, {AUC} AS a1 FROM xt GROUP BY dataset), b AS (SELECT dataset, {AUC} AS a2 FROM yt GROUP BY dataset)
   SELECT dataset, {R('a1', 6)} AS a1, {R('a2', 6)} AS a2, {R('a1 - a2', 6)} AS auc_diff FROM a JOIN b USING (dataset)""")
def _(t):
    left = t.preds.select("video_id", "dataset", "label", "video_score")
    both = left.join(t.preds_alt.select("video_id", "alt_score"), "video_id")
    one = roc.auc(both, "label", "video_score", DS).withColumnRenamed("auc", "a1")
    two = roc.auc(both, "label", "alt_score", DS).withColumnRenamed("auc", "a2")
    return r6(one.join(two, DS).withColumn("auc_diff", F.col("a1") - F.col("a2")), "a1", "a2", "auc_diff")


@query("m10_mcnemar", "preds_alt", """SELECT dataset, count(*) FILTER (c1 AND NOT c2) AS b, count(*) FILTER (NOT c1 AND c2) AS c FROM (
   SELECT dataset, (video_score >= 0.3)::INT = label AS c1, (alt_score >= 0.4)::INT = label AS c2 FROM preds_alt) GROUP BY dataset""")
def _(t):
    p = t.preds_alt.withColumns(
        {"p1": (F.col("video_score") >= 0.3).cast("int"), "p2": (F.col("alt_score") >= 0.4).cast("int")}
    )
    return roc.mcnemar(p, "label", "p1", "p2", DS).drop("p_value")


@query("m10_mcnemar_p_value")
def _(t):
    p = t.preds_alt.withColumns(
        {"p1": (F.col("video_score") >= 0.3).cast("int"), "p2": (F.col("alt_score") >= 0.31).cast("int")}
    )
    return r6(roc.mcnemar(p, "label", "p1", "p2", [*DS, "compression"]), "p_value")


@query("m11_bootstrap_ci", "preds", f"""WITH RECURSIVE {boot_sql('preds', 'video_score', 2000)}, {boot_auc_sql('video_score', 'v')}
   SELECT dataset, count(auc) AS n_valid, {R('quantile_cont(auc, 0.025)', 6)} AS lo, {R('quantile_cont(auc, 0.975)', 6)} AS hi
   FROM v GROUP BY dataset""")
def _(t):
    out = roc.bootstrap_ci(t.preds, "auc", "label", "video_score", "video_id", by=DS)
    return r6(out.drop("point"), "lo", "hi")


def mean_gap(y, s):
    """Difference of the classes' mean scores: any function of labels and scores will do."""
    return s[y == 1].mean() - s[y == 0].mean()


@query("x1_pluggable_metric", "preds", f"""WITH RECURSIVE {boot_sql('preds', 'video_score', 2000)},
   v AS (SELECT dataset, rep, sum(w * label * video_score) / nullif(sum(w * label), 0) - sum(w * (1 - label) * video_score) / nullif(sum(w * (1 - label)), 0) AS gap
      FROM drawn GROUP BY dataset, rep),
   p AS (SELECT dataset, avg(video_score) FILTER (label = 1) - avg(video_score) FILTER (label = 0) AS point FROM preds GROUP BY dataset)
   SELECT dataset, {R('any_value(point)', 6)} AS point, count(gap) AS n_valid, {R('quantile_cont(gap, 0.025)', 6)} AS lo, {R('quantile_cont(gap, 0.975)', 6)} AS hi
   FROM v JOIN p USING (dataset) GROUP BY dataset""")
def _(t):
    return r6(roc.bootstrap_ci(t.preds, mean_gap, "label", "video_score", "video_id", by=DS), "point", "lo", "hi")


VAL = "v AS (SELECT 1 AS g, * FROM preds_split WHERE split = 'val')"


@query("m12_threshold_eer", "preds_split", f"""WITH {VAL}, {roc_sql('v', 'g')} SELECT {EER_THR} AS threshold FROM t""")
def _(t):
    return roc.threshold(t.preds_split.where("split = 'val'"), "label", "video_score")


@query("m12_threshold_youden", "preds_split", f"""WITH {roc_sql('preds_split', 'split')}
   SELECT split, (max(CASE WHEN corner THEN {{'j': tpr - fpr, 's': score}} END)).s AS threshold FROM t GROUP BY split""")
def _(t):
    return roc.threshold(t.preds_split, "label", "video_score", "youden", ["split"])


@query("m12_threshold_f1", "preds_split", """WITH ts AS (SELECT DISTINCT split, round(video_score, 4) AS thr FROM preds_split),
   f AS (SELECT ts.split, thr, 2 * count(*) FILTER (label = 1 AND video_score >= thr) / (count(*) FILTER (label = 1) + count(*) FILTER (video_score >= thr))::DOUBLE AS f1
     FROM ts JOIN preds_split p ON p.split = ts.split GROUP BY ts.split, thr)
   SELECT split, -(max({'f': f1, 't': -thr})).t AS threshold FROM f GROUP BY split""")
def _(t):
    return roc.threshold(t.preds_split, "label", "video_score", "f1", ["split"])


@query("m13_decisions", "preds", """SELECT dataset, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
   round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
   round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
   SELECT dataset, count(*) FILTER (label = 1 AND video_score >= 0.3) AS tp, count(*) FILTER (label = 0 AND video_score >= 0.3) AS fp,
     count(*) FILTER (label = 1 AND video_score < 0.3) AS fn, count(*) FILTER (label = 0 AND video_score < 0.3) AS tn FROM preds GROUP BY dataset)""")
def _(t):
    d = M.decisions(t.preds, "label", "video_score", 0.3, DS)
    return d.withColumns({k: F.round(k, 6) for k in ("accuracy", "precision", "recall", "f1")})


BINS = f"""b AS (SELECT dataset, {bin15('video_score')} AS bin, count(*) AS k, avg(label::DOUBLE) AS y, avg(video_score) AS s FROM preds GROUP BY 1, 2)"""


@query("m14_ece", "preds", f"""WITH {BINS} SELECT dataset, {R('sum(CASE WHEN bin IS NULL THEN 0 ELSE k * abs(y - s) END) / sum(k)', 6)} AS ece FROM b GROUP BY dataset""")
def _(t):
    return r6(M.ece(t.preds, "label", "video_score", by=DS), "ece")


@query("m15_mce", "preds", f"""WITH {BINS} SELECT dataset, {R('coalesce(max(abs(y - s)) FILTER (k >= 10 AND bin IS NOT NULL), 0)', 6)} AS mce FROM b GROUP BY dataset""")
def _(t):
    return r6(M.mce(t.preds, "label", "video_score", by=DS), "mce")


@query("m16_reliability_curve", "preds", f"""WITH {BINS}, f AS (SELECT dataset, unnest(range(15)) AS bin FROM (SELECT DISTINCT dataset FROM preds))
   SELECT dataset, bin::INT AS bin, {R(f'(bin * {1 / 15!r}::DOUBLE + (bin + 1) * {1 / 15!r}::DOUBLE) / 2', 6)} AS centre, {R('y', 6)} AS observed, coalesce(k, 0) AS n
   FROM f LEFT JOIN b USING (dataset, bin)""")
def _(t):
    return r6(M.reliability(t.preds, "label", "video_score", by=DS), "centre", "observed")


@query("m17_brier", "preds", f"""SELECT dataset, {R('avg((least(greatest(video_score, 0), 1) - label) * (least(greatest(video_score, 0), 1) - label))', 6)} AS brier FROM preds GROUP BY dataset""")
def _(t):
    return r6(M.brier(t.preds, "label", "video_score", DS), "brier")


CURVE = f"""c AS (SELECT dataset, video_id, abs(video_score - 0.3::DOUBLE) AS conf, ((video_score >= 0.3::DOUBLE)::INT = label)::INT AS ok, {H('video_id')} AS u FROM preds),
   k AS (SELECT *, row_number() OVER w AS rank, sum(ok) OVER (PARTITION BY dataset ORDER BY conf DESC, u, video_id ROWS UNBOUNDED PRECEDING) AS cum,
     count(*) OVER (PARTITION BY dataset) AS n FROM c WINDOW w AS (PARTITION BY dataset ORDER BY conf DESC, u, video_id)),
   rc AS (SELECT dataset, video_id, rank, n, rank / n AS coverage, 1.0::DOUBLE - cum / rank::DOUBLE AS risk FROM k)"""


@query("m18_risk_coverage", "preds", f"WITH {CURVE} SELECT dataset, video_id, rank, {R('coverage', 6)} AS coverage, {R('risk', 6)} AS risk FROM rc")
def _(t):
    return r6(M.risk_coverage(t.preds, "label", "video_score", 0.3, "video_id", DS), "coverage", "risk")


_RISK = """SELECT l.dataset, cov AS coverage, CASE WHEN cov <= l.coverage OR h.risk IS NULL THEN l.risk
     ELSE l.risk + (h.risk - l.risk) / (h.coverage - l.coverage) * (cov - l.coverage) END AS risk
   FROM (SELECT dataset, cov, greatest(count(*) FILTER (coverage <= cov), 1) AS k
     FROM rc, (SELECT unnest([0.9::DOUBLE, 0.8::DOUBLE, 0.7::DOUBLE]) AS cov) GROUP BY 1, 2) q
   JOIN rc l ON l.dataset = q.dataset AND l.rank = q.k LEFT JOIN rc h ON h.dataset = q.dataset AND h.rank = q.k + 1"""


@query("m19_selective_risk", "preds", f"WITH {CURVE} SELECT dataset, coverage, {R('risk', 6)} AS risk FROM ({_RISK})")
def _(t):
    return r6(M.risk_at(t.preds, "label", "video_score", 0.3, (0.9, 0.8, 0.7), "video_id", DS), "risk")


@query("m20_abstain_rate", "preds", f"""SELECT dataset, {R('avg((video_score >= 0.25 AND video_score <= 0.35)::INT)', 6)} AS abstain_rate FROM preds GROUP BY dataset""")
def _(t):
    p = t.preds.withColumn("abstain", F.col("video_score").between(0.25, 0.35))
    return r6(M.abstain_rate(p, "abstain", DS), "abstain_rate")


def report_sql(src: str, thr: str) -> str:
    """Metric rows of ``src(name, label, video_score, video_id, abstain)`` at the scalar ``thr``."""
    return f"""{roc_sql(src, 'name', pre='e')},
   ranked AS (SELECT name, max(p) + max(n) AS n, max(p) AS n_pos, max(n) AS n_neg, {AUC} AS auc, {pauc(0.1)} AS pauc10, {AP} AS ap, {EER} AS eer,
     {tpr_at(0.01)} AS tpr_at_1fpr, {tpr_at(0.05)} AS tpr_at_5fpr, {tpr_at(0.1)} AS tpr_at_10fpr, {VAR} AS v FROM et GROUP BY name),
   ci AS (SELECT *, ln(auc / (1.0::DOUBLE - auc + 1e-12) + 1e-12) AS c, sqrt(v) / (auc * (1.0::DOUBLE - auc) + 1e-12) * {Z95}::DOUBLE AS h FROM ranked),
   conf AS (SELECT name, count(*) FILTER (label = 1 AND video_score >= {thr}) AS tp, count(*) FILTER (label = 0 AND video_score >= {thr}) AS fp,
     count(*) FILTER (label = 1 AND video_score < {thr}) AS fn, count(*) FILTER (label = 0 AND video_score < {thr}) AS tn,
     avg((video_score - label) * (video_score - label)) AS brier, avg(abstain::INT) AS abstain_rate FROM {src} GROUP BY name),
   bb AS (SELECT name, {bin15('video_score')} AS bin, count(*) AS k, avg(label::DOUBLE) AS y, avg(video_score) AS s FROM {src} GROUP BY 1, 2),
   cal AS (SELECT name, sum(k * abs(y - s)) / sum(k) AS ece, coalesce(max(abs(y - s)) FILTER (k >= 10), 0) AS mce FROM bb GROUP BY name),
   ck AS (SELECT name AS dataset, row_number() OVER w AS rank, count(*) OVER (PARTITION BY name) AS n,
     sum(ok) OVER (PARTITION BY name ORDER BY conf DESC, u, video_id ROWS UNBOUNDED PRECEDING) AS cum FROM (
       SELECT name, video_id, abs(video_score - {thr}) AS conf, ((video_score >= {thr})::INT = label)::INT AS ok, {H('video_id')} AS u FROM {src})
     WINDOW w AS (PARTITION BY name ORDER BY conf DESC, u, video_id)),
   rc AS (SELECT dataset, rank, rank / n AS coverage, 1.0::DOUBLE - cum / rank::DOUBLE AS risk FROM ck),
   rk AS (SELECT dataset AS name, max(risk) FILTER (coverage = 0.9::DOUBLE) AS risk_at_90cov, max(risk) FILTER (coverage = 0.8::DOUBLE) AS risk_at_80cov,
     max(risk) FILTER (coverage = 0.7::DOUBLE) AS risk_at_70cov FROM ({_RISK}) GROUP BY 1)"""


FLOATS = ["auc", "auc_lo", "auc_hi", "pauc10", "ap", "eer", "tpr_at_1fpr", "tpr_at_5fpr", "tpr_at_10fpr", "accuracy",
          "precision", "recall", "f1", "ece", "mce", "brier", "abstain_rate", "risk_at_90cov", "risk_at_80cov", "risk_at_70cov"]

_EXPR = {
    "auc_lo": CI_LO, "auc_hi": CI_HI, "accuracy": "(tp + tn) / (tp + fp + fn + tn)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
}
REPORT_COLS = "name, n, n_pos, n_neg, tp, fp, fn, tn, " + ", ".join(f"{R(f'({_EXPR.get(k, k)}) + 1e-9::DOUBLE', 6)} AS {k}" for k in FLOATS)
REPORT_FROM = "ci JOIN conf USING (name) JOIN cal USING (name) JOIN rk USING (name)"


def report(df):
    out = df.select("name", "n", "n_pos", "n_neg", "tp", "fp", "fn", "tn", *FLOATS)
    # The nudge keeps exact halves, common in small groups, from hanging on summation order.
    return out.withColumns({k: half_up(F.col(k) + 1e-9, 6) for k in FLOATS})


@query("m21_metric_row", "preds", f"""WITH src AS (SELECT *, dataset AS name, (video_score >= 0.25 AND video_score <= 0.35) AS abstain FROM preds),
   {report_sql('src', '0.3::DOUBLE')} SELECT {REPORT_COLS} FROM {REPORT_FROM}""")
def _(t):
    p = t.preds.withColumns({"abstain": F.col("video_score").between(0.25, 0.35), "name": F.col("dataset")})
    return report(M.evaluate(p, 0.3, "fixed for this query", ["name"], abstain="abstain"))


RUN_SQL = f"""WITH {VAL}, {roc_sql('v', 'g', pre='z')}, thr AS (SELECT {EER_THR} AS threshold FROM zt),
   x AS (SELECT *, (video_score >= 0.25 AND video_score <= 0.35) AS abstain FROM preds_split),
   src AS (SELECT split AS name, * FROM x UNION ALL SELECT split || '/forgery_method=' || forgery_method, * FROM x
      UNION ALL SELECT split || '/compression=' || compression, * FROM x),
   {report_sql('src', '(SELECT threshold FROM thr)')} SELECT {REPORT_COLS} FROM {REPORT_FROM} WHERE n >= 10 OR name NOT LIKE '%/%'"""


@query("m22_breakdown_report", "preds_split", RUN_SQL)
def _(t):
    p = t.preds_split.withColumn("abstain", F.col("video_score").between(0.25, 0.35))
    return report(M.evaluate_run(p, keys=["forgery_method", "compression"]))


@query("m22_evaluate_split", "preds_split", f"""WITH {VAL}, {roc_sql('v', 'g', pre='z')}, thr AS (SELECT {EER_THR} AS threshold FROM zt),
   x AS (SELECT *, false AS abstain FROM preds_split WHERE split = 'test'),
   src AS (SELECT 'all' AS name, * FROM x UNION ALL SELECT 'all/dataset=' || dataset, * FROM x),
   {report_sql('src', '(SELECT threshold FROM thr)')} SELECT name, n, {R('auc', 6)} AS auc, {R(_EXPR['accuracy'], 6)} AS accuracy, {R('ece', 6)} AS ece FROM {REPORT_FROM}""")
def _(t):
    val, test = t.preds_split.where("split = 'val'"), t.preds_split.where("split = 'test'")
    return r6(M.evaluate_split(test, val, key="dataset").select("name", "n", "auc", "accuracy", "ece"), "auc", "accuracy", "ece")


@query("m24_psi", "preds_split", f"""WITH c AS (SELECT dataset, bin, count(*) FILTER (split = 'val') AS nb, count(*) FILTER (split = 'test') AS nl FROM (
     SELECT dataset, split, least(len(list_filter([{', '.join(f'{i} * 0.1::DOUBLE' for i in range(1, 10))}], lambda e: video_score >= e)), 9) AS bin FROM preds_split) GROUP BY 1, 2),
   f AS (SELECT d.dataset, b.bin, coalesce(nb, 0) AS nb, coalesce(nl, 0) AS nl FROM (SELECT dataset FROM c GROUP BY dataset HAVING sum(nb) + sum(nl) > 0) d CROSS JOIN (SELECT unnest(range(10)) AS bin) b
     LEFT JOIN c ON c.dataset = d.dataset AND c.bin = b.bin),
   g AS (SELECT *, (nb + 1e-6::DOUBLE) / (sum(nb) OVER (PARTITION BY dataset) + 1e-5::DOUBLE) AS b, (nl + 1e-6::DOUBLE) / (sum(nl) OVER (PARTITION BY dataset) + 1e-5::DOUBLE) AS l FROM f)
   SELECT dataset, CASE WHEN sum(nb) >= 10 AND sum(nl) >= 10 THEN {R('sum((l - b) * ln(l / b))', 6)} END AS psi FROM g GROUP BY dataset""")
def _(t):
    p = t.preds_split
    return r6(M.psi(p.where("split = 'val'"), p.where("split = 'test'"), "video_score", by=DS), "psi")


@query("w2_midrank", "preds", """SELECT dataset, video_score AS score, rank() OVER (PARTITION BY dataset ORDER BY video_score) + (count(*) OVER (PARTITION BY dataset, video_score) - 1) / 2 AS midrank
   FROM preds QUALIFY row_number() OVER (PARTITION BY dataset, video_score ORDER BY video_id) = 1""")
def _(t):
    table = roc.score_table(t.preds, "label", "video_score", DS)
    above = F.col("pos_before") + F.col("neg_before")
    here, total = F.col("pos") + F.col("neg"), F.col("pos_total") + F.col("neg_total")
    return table.select("dataset", "score", (total - above - here + (here + 1) / 2).alias("midrank"))


@query("w3_cumulative_hits", "preds", f"WITH {CURVE}, h AS (SELECT dataset, rank, sum(ok) OVER (PARTITION BY dataset ORDER BY rank)::BIGINT AS hits FROM k) SELECT * FROM h")
def _(t):
    curve = M.risk_coverage(t.preds, "label", "video_score", 0.3, "video_id", DS)
    return curve.select("dataset", "rank", F.round((1 - F.col("risk")) * F.col("rank")).cast("bigint").alias("hits"))


@query("j10_cross_gap", "preds_split", f"""WITH {roc_sql('preds_split', 'dataset, split')}, a AS (SELECT dataset AS exp, split, {AUC} AS auc FROM t GROUP BY 1, 2)
   SELECT b.exp, b.split AS test_set, {R('i.auc', 4)} AS in_dataset_auc, {R('b.auc', 4)} AS cross_dataset_auc, {R('i.auc - b.auc', 4)} AS gap
   FROM a b JOIN a i ON i.exp = b.exp AND i.split = 'val' WHERE b.split <> 'val'""")
def _(t):
    return M.cross_gap(roc.auc(t.preds_split, "label", "video_score", ["dataset", "split"]).withColumnRenamed("dataset", "exp"))


@query("q3_evaluate_run", "preds_split", f"""WITH rep AS ({RUN_SQL}) SELECT rep.*, CASE WHEN name <> 'val' AND NOT contains(name, '/') THEN {R('base - auc', 4)} END AS gap
   FROM rep, (SELECT max(auc) FILTER (name = 'val') AS base FROM rep)""")
def _(t):
    from ..session import new_path
    from ..sources.runs import write_reports

    p = t.preds_split.withColumn("abstain", F.col("video_score").between(0.25, 0.35))
    found, path = M.evaluate_run(p, keys=["forgery_method", "compression"]), new_path(t.spark, "reports")
    write_reports(found, path)
    stored = report(t.spark.read.schema(found.schema).json(f"{path}/json"))
    gaps = M.cross_gap(stored.withColumn("exp", F.lit("run")), split="name").select(F.col("test_set").alias("name"), "gap")
    return stored.join(gaps, "name", "left").orderBy("name")
