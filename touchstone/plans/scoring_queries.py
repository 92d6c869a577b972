"""Queries over logits, vectors, frames and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import verdicts as V
from ..functions.hashing import hash_fraction
from ..functions.numeric import half_up, logit
from ..operators import calibration as C
from ..operators import clips as K
from ..operators import ood, roc
from .fixtures import H, R
from .metric_queries import AUC, EER_THR, VAL, r6, roc_sql
from .registry import query

SIG = lambda z: f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))))"
T0 = 1.7
CAL = C.Calibration(
    temperature=T0, threshold=0.4, conformal_lo=0.35, conformal_hi=0.45, ood_threshold=-0.75, fitted_on="fixed", n_val=1000
)
ENERGY = "(-(abs(logit) / 2 + ln(1.0::DOUBLE + exp(-abs(logit)))))"
SCORED = f"""sc AS (SELECT *, {SIG(f'logit / {T0}::DOUBLE')} AS p, {ENERGY} AS e FROM preds_logit),
  vd AS (SELECT *, (p >= 0.35::DOUBLE AND p <= 0.45::DOUBLE) AS abstain, e > -0.75::DOUBLE AS ood FROM sc),
  rs AS (SELECT *, CASE WHEN abstain OR ood THEN 'inconclusive' WHEN p >= 0.4::DOUBLE THEN 'likely_manipulated' ELSE 'likely_authentic' END AS verdict FROM vd)"""


#: Bisection on the slope of the loss in 1/T, in log steps.
@query("c1_fit_temperature", "preds_logit", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT logit AS z, label AS y FROM preds_logit WHERE split = 'val'),
   s(i, lo, hi) AS (SELECT 0, ln(1e-3::DOUBLE), ln(1e3::DOUBLE) UNION ALL
     SELECT s.i + 1, CASE WHEN sum(({SIG('z * exp((lo + hi) / 2)')} - y) * z) > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN sum(({SIG('z * exp((lo + hi) / 2)')} - y) * z) > 0 THEN (lo + hi) / 2 ELSE hi END
     FROM s, v WHERE s.i < 60 GROUP BY s.i, lo, hi),
   f AS (SELECT exp(-(lo + hi) / 2) AS temp FROM s ORDER BY i DESC LIMIT 1)
   SELECT {R(f'least(greatest(temp, {C.T_MIN!r}), {C.T_MAX!r})', 5)} AS temperature, NOT temp BETWEEN {C.T_MIN!r} AND {C.T_MAX!r} AS clamped FROM f""")
def _(t):
    temp, clamped = C.fit_temperature(t.preds_logit.where("split = 'val'"))
    return t.spark.range(1).select(half_up(F.lit(temp), 5).alias("temperature"), F.lit(clamped).alias("clamped"))


_SUMS = f"""sum({SIG('z * a + b')} - y) AS gb, sum(({SIG('z * a + b')} - y) * z) AS ga, sum({SIG('z * a + b')} * (1 - {SIG('z * a + b')})) AS hbb,
     sum({SIG('z * a + b')} * (1 - {SIG('z * a + b')}) * z) AS hab, sum({SIG('z * a + b')} * (1 - {SIG('z * a + b')}) * z * z) AS haa"""


@query("c2_fit_vector", "preds_logit", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT logit AS z, label AS y FROM preds_logit WHERE split = 'val'),
   s(i, a, b) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL
     SELECT i + 1, a - da * least(1, 5 / greatest(abs(da), abs(db), 1e-9)), b - db * least(1, 5 / greatest(abs(da), abs(db), 1e-9)) FROM (
       SELECT i, a, b, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db
       FROM (SELECT s.i, a, b, {_SUMS} FROM s, v WHERE s.i < 25 GROUP BY s.i, a, b)))
   SELECT {R('a', 5)} AS a, {R('b', 5)} AS b FROM s ORDER BY i DESC LIMIT 1""")
def _(t):
    a, b = C.fit_vector(t.preds_logit.where("split = 'val'"))
    return t.spark.range(1).select(half_up(F.lit(a), 5).alias("a"), half_up(F.lit(b), 5).alias("b"))


@query("c3_fit_bundle", "preds_logit", f"""WITH v AS (SELECT 1 AS g, label, {SIG('logit')} AS p, {ENERGY} AS e FROM preds_logit WHERE split = 'val'),
   {roc_sql('v', 'g', 'p')}, th AS (SELECT {EER_THR} AS threshold FROM t),
   nc AS (SELECT 1.0::DOUBLE - CASE WHEN label = 1 THEN p ELSE 1.0::DOUBLE - p END AS nc FROM v),
   q AS (SELECT (list_sort(list(nc)))[(ceil(least(ceil((count(*) + 1) * 0.9::DOUBLE) / count(*), 1) * (count(*) - 1)))::BIGINT + 1] AS q, count(*) AS n FROM nc)
   SELECT n AS n_val, {R('threshold', 6)} AS threshold, {R('least(q, 1 - q)', 6)} AS conformal_lo, {R('greatest(q, 1 - q)', 6)} AS conformal_hi,
     {R('(SELECT quantile_cont(e, 0.95) FROM v)', 6)} AS ood_threshold, n < 100 AS degenerate FROM q, th""")
def _(t):
    cal = C.fit_calibration(t.preds_logit.where("split = 'val'"), method="none")
    out = cal.frame(t.spark).select("n_val", "threshold", "conformal_lo", "conformal_hi", "ood_threshold", "degenerate")
    return r6(out, "threshold", "conformal_lo", "conformal_hi", "ood_threshold")


@query("c4_conformal_band", "preds_split", f"""WITH x AS (SELECT split, 1.0::DOUBLE - CASE WHEN label = 1 THEN video_score ELSE 1.0::DOUBLE - video_score END AS nc FROM preds_split),
   q AS (SELECT split, count(*) AS n, (list_sort(list(nc)))[(ceil(least(ceil((count(*) + 1) * 0.8::DOUBLE) / count(*), 1) * (count(*) - 1)))::BIGINT + 1] AS q FROM x GROUP BY split)
   SELECT split, n, {R('least(q, 1 - q)', 6)} AS conformal_lo, {R('greatest(q, 1 - q)', 6)} AS conformal_hi FROM q""")
def _(t):
    return r6(C.conformal_band(t.preds_split, "video_score", "label", 0.2, ["split"]), "conformal_lo", "conformal_hi")


@query("c5_ood_cut", "preds_logit", f"SELECT split, {R(f'quantile_cont({ENERGY}, 0.95)', 6)} AS ood_threshold FROM preds_logit GROUP BY split")
def _(t):
    return r6(C.ood_cut(t.preds_logit.withColumn("e", C.energy("logit")), "e", 0.95, ["split"]), "ood_threshold")


@query("c6_apply_probability", "preds_logit", f"""SELECT video_id, {R(SIG(f'logit / {T0}::DOUBLE'), 6)} AS temperature,
   {R(SIG('logit * 0.8::DOUBLE + 0.3::DOUBLE'), 6)} AS vector, {R(SIG('logit'), 6)} AS none FROM preds_logit""")
def _(t):
    vec, none = C.Calibration(method="vector", a=0.8, b=0.3), C.Calibration.missing()
    out = t.preds_logit.select(
        "video_id",
        C.probability("logit", CAL).alias("temperature"),
        C.probability("logit", vec).alias("vector"),
        C.probability("logit", none).alias("none"),
    )
    return r6(out, "temperature", "vector", "none")


@query("c7_missing_calibration", "preds_logit", f"""SELECT video_id, {R(f"CASE WHEN dataset = 'ffpp' THEN {SIG('logit / 2.0::DOUBLE')} ELSE {SIG('logit')} END", 6)} AS calibrated_prob,
   CASE WHEN dataset = 'ffpp' THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END AS threshold,
   CASE WHEN dataset = 'ffpp' THEN 'fit' ELSE 'MISSING (uncalibrated)' END AS fitted_on FROM preds_logit""")
def _(t):
    state = C.Calibration(temperature=2.0, threshold=0.45, fitted_on="fit").frame(t.spark).withColumn("dataset", F.lit("ffpp"))
    out = C.apply_calibrations(t.preds_logit, state, "dataset")
    return r6(out.select("video_id", "calibrated_prob", "threshold", "fitted_on"), "calibrated_prob")


@query("c8_abstain_flag", "preds_logit", f"WITH {SCORED} SELECT abstain, count(*) AS n FROM rs GROUP BY abstain")
def _(t):
    return C.apply_calibration(t.preds_logit, CAL).groupBy("abstain").agg(F.count(F.lit(1)).alias("n"))


@query("c9_fit_mahalanobis", "vec", f"""WITH RECURSIVE x AS (SELECT vec_id, unnest(vec) AS v, unnest(range(len(vec))) + 1 AS j FROM vec WHERE label < 5),
   z AS MATERIALIZED (SELECT vec_id, j, v - avg(v) OVER (PARTITION BY j) AS v FROM x),
   g AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / (count(*) - 1) AS s FROM z a JOIN z b USING (vec_id) GROUP BY 1, 2),
   d AS (SELECT count(*) AS d, avg(s) AS t FROM g WHERE i = j),
   r AS (SELECT i, list(0.9::DOUBLE * s + CASE WHEN i = j THEN 0.1::DOUBLE * t ELSE 0 END ORDER BY j) || list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ORDER BY j) AS row FROM g, d GROUP BY i),
   gj(k, m) AS (SELECT 1::BIGINT, list(row ORDER BY i) FROM r UNION ALL
     SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN p ELSE list_transform(row, lambda e, j: e - row[k] * p[j]) END)
     FROM (SELECT k, m, list_transform(m[k], lambda e: e / m[k][k]) AS p FROM gj WHERE k <= len(m)))
   SELECT (SELECT count(DISTINCT vec_id) FROM x) AS n_fit, len(m)::INT AS dim,
     {R('list_sum(list_transform(m, lambda row, i: row[len(m) + i]))', 4)} AS trace FROM gj ORDER BY k DESC LIMIT 1""")
def _(t):
    s = ood.fit_mahalanobis(t.vec.where("label < 5"), "vec")
    return t.spark.range(1).select(
        F.lit(s.n_fit).alias("n_fit"), F.lit(s.dim).alias("dim"),
        half_up(F.lit(float(sum(r[i] for i, r in enumerate(s.precision)))), 4).alias("trace"),
    )


_MAHA = """st AS (SELECT j, avg(x) AS m, 1.0::DOUBLE / var_samp(x) AS iv FROM (SELECT unnest(vec) AS x, unnest(range(len(vec))) AS j FROM vec WHERE label < 5) GROUP BY j),
  md AS (SELECT vec_id, label, sum((x - m) * iv * (x - m)) AS d FROM (SELECT vec_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS j FROM vec) JOIN st USING (j) GROUP BY 1, 2)"""


def _diagonal_state(t):
    """Mean and diagonal precision of the familiar classes, from two aggregates."""
    rows = (
        t.vec.where("label < 5").select(F.posexplode("vec").alias("j", "x")).groupBy("j")
        .agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).orderBy("j").collect()
    )
    prec = [[1.0 / r["v"] if i == r["j"] else 0.0 for i in range(len(rows))] for r in rows]
    return ood.Mahalanobis([r["m"] for r in rows], prec, 0)


@query("c10_mahalanobis_score", "vec", f"WITH {_MAHA} SELECT vec_id, {R('d', 4)} AS distance FROM md")
def _(t):
    return t.vec.select("vec_id", half_up(ood.mahalanobis("vec", _diagonal_state(t)), 4).alias("distance"))


@query("m23_novelty_auroc", "vec", f"""WITH {_MAHA}, n AS (SELECT 1 AS g, (label >= 5)::INT AS label, d FROM md), {roc_sql('n', 'g', 'd')} SELECT {R(AUC, 4)} AS auc FROM t""")
def _(t):
    d = t.vec.withColumn("d", ood.mahalanobis("vec", _diagonal_state(t)))
    out = roc.novelty_auroc(d.where("label < 5"), d.where("label >= 5"), "d")
    return out.select(half_up("auc", 4).alias("auc"))


@query("c11_energy_score", "preds_logit", f"SELECT video_id, {R(ENERGY, 6)} AS energy FROM preds_logit")
def _(t):
    return t.preds_logit.select("video_id", half_up(C.energy("logit"), 6).alias("energy"))


@query("f10_verdict", "preds_logit", f"WITH {SCORED} SELECT video_id, verdict, {R('p', 6)} AS calibrated_prob, ood AS ood_flag, (verdict <> 'inconclusive' AND NOT ood) AS confident FROM rs")
def _(t):
    out = V.score_logits(t.preds_logit, CAL)
    return out.select("video_id", "verdict", half_up("calibrated_prob", 6).alias("calibrated_prob"), "ood_flag", V.is_confident().alias("confident"))


# ---- frames ----------------------------------------------------------------
_SEG = """o AS (SELECT *, row_number() OVER w AS i, lead(ts_s) OVER w AS nx, lag(score) OVER w AS pv FROM frames WINDOW w AS (PARTITION BY clip ORDER BY ts_s, event_id)),
  g AS (SELECT clip, (list_sort(list(nx - ts_s) FILTER (nx > ts_s)))[count(*) FILTER (nx > ts_s) // 2 + 1] AS step FROM o GROUP BY clip),
  f AS (SELECT o.*, coalesce(nx, ts_s + coalesce(step, 1)) AS e, (score >= 0.3 AND coalesce(pv < 0.3, true))::INT AS st FROM o JOIN g USING (clip)),
  r AS (SELECT clip, run, min(i) AS a, max(i) AS b, min(ts_s) AS s, arg_max(e, i) AS e, max({'x': score, 'r': -i, 't': ts_s}) AS pk FROM (
    SELECT *, sum(st) OVER (PARTITION BY clip ORDER BY i) AS run FROM f) WHERE score >= 0.3 GROUP BY clip, run),
  q AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY a) AS seg FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY clip ORDER BY a) <= 20000 THEN 0 ELSE 1 END AS nw FROM r))"""


@query("w1_suspicious_segments", "frames", f"""WITH {_SEG} SELECT clip, {R('min(s)', 3)} AS start_s, {R('arg_max(e, b)', 3)} AS end_s, {R('max(pk).x', 4)} AS peak_score,
   {R('max(pk).t', 3)} AS peak_time_s, max(b) - min(a) + 1 AS n_frames FROM q GROUP BY clip, seg""")
def _(t):
    return K.segments(t.frames, thr=0.3, merge_gap=20000.0, tie="event_id", chunk_s=86400.0)


@query("t4_top_frames", "frames", "SELECT clip, event_id, row_number() OVER (PARTITION BY clip ORDER BY score DESC, ts_s) AS rank FROM frames QUALIFY rank <= 3")
def _(t):
    return K.top_frames(t.frames, "clip", "score").select("clip", "event_id", "rank")


@query("j18_interval_overlap", "intervals", f"""WITH x AS (SELECT f.clip, f.score >= 0.2 AS hit, EXISTS (SELECT 1 FROM intervals i WHERE i.clip = f.clip AND f.ts_s BETWEEN i.start_s AND i.end_s) AS ins FROM frames f)
   SELECT clip, count(*) AS n, count(*) FILTER (ins) AS n_inside, count(*) FILTER (hit AND ins) AS tp, count(*) FILTER (hit AND NOT ins) AS fp, count(*) FILTER (NOT hit AND ins) AS fn,
     {R('count(*) FILTER (hit AND ins) / nullif(count(*) FILTER (hit OR ins), 0)', 6)} AS iou FROM x GROUP BY clip""")
def _(t):
    return r6(K.localisation(t.frames, t.intervals, 0.2), "iou")


_GAP = "sqrt(pow((b.x0 + b.x1) / 2 - w.cx, 2) + pow((b.y0 + b.y1) / 2 - w.cy, 2))"


@query("w7_face_track", "boxes", f"""WITH RECURSIVE bx AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM boxes),
   an AS (SELECT clip, frame, seq, x0, y0, x1, y1 FROM bx QUALIFY row_number() OVER (PARTITION BY clip ORDER BY area DESC, frame, seq) = 1),
   fr AS (SELECT b.*, sign(b.frame - an.frame) AS side, dense_rank() OVER (PARTITION BY b.clip, sign(b.frame - an.frame) ORDER BY abs(b.frame - an.frame)) AS k
     FROM bx b JOIN an USING (clip) WHERE b.frame <> an.frame),
   w(clip, side, k, frame, seq, cx, cy) AS (
     SELECT clip, side, 0::BIGINT, frame, seq, (x0 + x1) / 2, (y0 + y1) / 2 FROM an, (SELECT unnest([-1, 1]) AS side)
     UNION ALL SELECT clip, side, k, frame, pick.seq, pick.cx, pick.cy FROM (
       SELECT w.clip, w.side, w.k + 1 AS k, any_value(b.frame) AS frame, CASE WHEN min({_GAP}) <= {0.25 * (1280.0**2 + 720.0**2) ** 0.5!r}::DOUBLE
         THEN arg_min({{'seq': b.seq, 'cx': (b.x0 + b.x1) / 2, 'cy': (b.y0 + b.y1) / 2}}, {{'g': {_GAP}, 's': b.seq}})
         ELSE arg_min({{'seq': b.seq, 'cx': (b.x0 + b.x1) / 2, 'cy': (b.y0 + b.y1) / 2}}, {{'a': -b.area, 's': b.seq}}) END AS pick
       FROM w JOIN fr b ON b.clip = w.clip AND b.side = w.side AND b.k = w.k + 1 GROUP BY w.clip, w.side, w.k))
   SELECT DISTINCT clip, frame, seq FROM w""")
def _(t):
    return K.main_track(t.boxes).select("clip", "frame", "seq")


_OFF = """sz AS (SELECT clip, count(*) AS n_w, least(5, greatest(count(*) - 2, 0)) AS k FROM win GROUP BY clip),
  p AS (SELECT l.clip, n_w, k, o.off, 1.0::DOUBLE - list_sum(list_transform(list_zip(l.v, r.a), lambda z: z[1] * z[2])) AS d
    FROM win l JOIN sz USING (clip), (SELECT unnest(range(-5, 6)) AS off) o, win r WHERE abs(o.off) <= k AND r.clip = l.clip AND r.w = l.w + o.off),
  cu AS (SELECT clip, n_w, k, off, avg(d) AS m, var_pop(d) * count(*) AS ss FROM p GROUP BY ALL)"""


@query("w9_offset_search", "win", f"""WITH {_OFF} SELECT clip, arg_min(off, {{'m': m, 'o': off}})::INT AS best_offset, {R('min(m)', 6)} AS min_dist,
   {R('CASE WHEN max(k) = 0 THEN 0 ELSE (list_sort(list(m)))[(count(*) + 1) // 2] - min(m) END', 6)} AS conf,
   {R("CASE WHEN max(k) = 0 THEN 0 ELSE arg_min(off, {'m': m, 'o': off}) / max(k) END", 6)} AS offset_norm,
   {R('avg(m)', 6)} AS mean_dist, {R("sqrt(arg_min(ss, {'m': m, 'o': off}) / nullif(max(n_w) - 1, 0))", 6)} AS curve_std FROM cu GROUP BY clip""")
def _(t):
    return r6(K.offset_search(t.win), "min_dist", "conf", "offset_norm", "mean_dist", "curve_std")


@query("j14_shift_alignment", "win", f"""WITH {_OFF} SELECT clip, off::INT AS off, n, {R('m', 6)} AS mean_dist FROM (SELECT clip, off, m, (SELECT count(*) FROM p WHERE p.clip = cu.clip AND p.off = cu.off) AS n FROM cu)""")
def _(t):
    w = t.win
    size = w.groupBy("clip").agg(F.least(F.lit(5), F.greatest(F.count(F.lit(1)) - 2, F.lit(0))).cast("int").alias("k"))
    left = w.select("clip", "w", "v").join(size, "clip").withColumn("off", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    right = w.select("clip", F.col("w").alias("u"), "a")
    pairs = left.join(right, (left["clip"] == right["clip"]) & (right["u"] == left["w"] + left["off"])).drop(right["clip"])
    dist = 1.0 - F.aggregate(F.zip_with("v", "a", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    out = pairs.groupBy("clip", "off").agg(F.count(F.lit(1)).alias("n"), F.avg(dist).alias("mean_dist"))
    return r6(out, "mean_dist")


_SAMPLES = "s AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY ts_s, event_id) - 1 AS i, value / 500.0::DOUBLE AS y FROM frames)"


@query("a22_energy_snr", "frames", f"""WITH {_SAMPLES}, e AS (SELECT clip, i // 3 AS win, avg(y * y) AS e FROM s GROUP BY 1, 2 HAVING count(*) = 3),
   q AS (SELECT clip, quantile_cont(e, 0.9) AS hi, quantile_cont(e, 0.1) AS lo FROM e GROUP BY clip), n AS (SELECT clip, count(*) AS n FROM s GROUP BY clip)
   SELECT clip, {R('CASE WHEN n >= 15 AND n // 3 >= 4 AND hi > 1e-12 THEN least(greatest(log10((hi + 1e-12) / (lo + 1e-12)) * 10 / 40, 0), 1) ELSE 0 END', 6)} AS snr FROM n LEFT JOIN q USING (clip)""")
def _(t):
    from ..operators.ordered import running_sums

    rows = t.frames.selectExpr("clip", "ts_s", "event_id", "value / 500D AS y", "1L AS one", "CAST(floor(ts_s / 86400) AS BIGINT) AS chunk")
    numbered = running_sums(rows, ["clip"], ["chunk"], ["ts_s", "event_id"], ["one"]).withColumnRenamed("one_before", "i")
    return r6(K.energy_snr(numbered, ["clip"], 150), "snr")


# ---- array functions ---------------------------------------------------------
def _joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("f6_frame_indices", "manifest", """SELECT video_id,
   CASE WHEN n <= 16 THEN list_aggregate(range(0, n), 'string_agg', ',') ELSE list_aggregate(list_transform(range(0, 16), lambda i: CASE WHEN i = 15 THEN n - 1 ELSE floor(i * ((n - 1) / 15.0::DOUBLE))::BIGINT END), 'string_agg', ',') END AS uniform,
   CASE WHEN n <= 16 THEN list_aggregate(range(0, n), 'string_agg', ',') ELSE list_aggregate(range((n - 16) // 2, (n - 16) // 2 + 16), 'string_agg', ',') END AS dense
   FROM (SELECT video_id, greatest(n_frames::BIGINT, 1) AS n FROM manifest)""")
def _(t):
    return t.manifest.select(
        "video_id", _joined(fr.frame_indices("n_frames", 16)).alias("uniform"),
        _joined(fr.frame_indices("n_frames", 16, "dense")).alias("dense"),
    )


@query("f6_frame_indices_random")
def _(t):
    from ..functions.hashing import sample_seed

    return t.manifest.select("video_id", _joined(fr.frame_indices("n_frames", 8, "random", sample_seed("video_id"))).alias("random"))


@query("f7_timestamps", "manifest", f"""SELECT video_id, {R('list_sum(list_transform(range(0, least(n, 8)), lambda i: ' + R('CASE WHEN n <= 8 THEN i WHEN i = 7 THEN n - 1 ELSE floor(i * ((n - 1) / 7.0::DOUBLE)) END / 23.976::DOUBLE', 4) + '))', 3)} AS total
   FROM (SELECT video_id, greatest(n_frames::BIGINT, 1) AS n FROM manifest)""")
def _(t):
    ts = fr.timestamps(fr.frame_indices("n_frames", 8), F.lit(23.976))
    total = F.aggregate(ts, F.lit(0.0), lambda s, x: s + x)
    return t.manifest.select("video_id", half_up(total, 3).alias("total"))


@query("w10_fixed_windows", "vec", f"""SELECT vec_id, list_aggregate(list_transform(range(0, 5), lambda i: {R("list_sum(list_slice(vec, CASE WHEN i = 4 THEN len(vec) - 16 ELSE floor(i * ((len(vec) - 16) / 4.0::DOUBLE))::BIGINT END + 1, CASE WHEN i = 4 THEN len(vec) - 16 ELSE floor(i * ((len(vec) - 16) / 4.0::DOUBLE))::BIGINT END + 16))", 4)} * 10000), 'sum') AS total FROM vec""")
def _(t):
    sums = F.transform(fr.windows("vec", 5), lambda w: half_up(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), 4) * 10000.0)
    return t.vec.select("vec_id", F.aggregate(sums, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("f8_bit_signature", "vec", """SELECT vec_id, list_aggregate(list_transform(range(1, 65), lambda i: CASE WHEN vec[i] > m THEN '1' ELSE '0' END), 'string_agg', '') AS bits
   FROM (SELECT vec_id, vec, (list_sort(vec[2:64]))[32] AS m FROM vec)""")
def _(t):
    return t.vec.select("vec_id", F.lpad(F.bin(fr.bit_signature("vec")), 64, "0").alias("bits"))


@query("f8_transform_signature")
def _(t):
    patch = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.slice("vec", 1, 64)))
    low = t.vec.select("vec_id", fr.cosine_transform_2d(patch, 16).alias("low"))
    return low.select("vec_id", fr.bit_signature("low").alias("signature"))


@query("p7_small_faces", "boxes", """SELECT clip, count(*) AS n, count(*) FILTER (least(x1 - x0, y1 - y0) >= 48) AS kept FROM boxes GROUP BY clip""")
def _(t):
    b = t.boxes.select("clip", F.explode(fr.drop_small_faces(F.array(F.array("x0", "y0", "x1", "y1")))).alias("box"))
    return b.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.count("box").alias("kept"))


@query("a21_reliability_vector", "boxes", f"""SELECT seq, {R('CASE WHEN seq % 3 <> 0 THEN ' + R('conf', 4) + ' ELSE 0 END', 4)} AS audio_snr,
   {R('coalesce(CASE WHEN conf > 0 AND conf > 0.5 THEN (conf + conf - 0.5::DOUBLE) / 2 WHEN conf > 0 THEN conf END, 0)', 4)} AS face_conf,
   CASE WHEN seq % 20 >= 4 THEN {R('(seq % 20) / 16', 4)} ELSE 0.0::DOUBLE END AS mouth_vis, {R('(conf + 0.25::DOUBLE) / 2', 4)} AS blur FROM boxes""")
def _(t):
    ok = (F.col("seq") % 20).cast("int")
    rel = fr.reliability(
        "conf", F.array("conf", F.greatest(F.col("conf") - 0.5, F.lit(0.0))), ok, F.lit(16), F.array("conf", F.lit(0.25)),
        F.col("seq") % 3 != 0, fr.mouth_available(ok, F.lit(16)),
    )
    return t.boxes.select("seq", *[rel[i].alias(n) for i, n in enumerate(["audio_snr", "face_conf", "mouth_vis", "blur"])])
