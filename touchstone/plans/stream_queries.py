"""Queries over streams, each drained to a table that its batch twin must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..functions.numeric import half_up
from ..operators import monitor as N
from ..streaming import jobs as J
from ..streaming import monitors as L
from ..streaming.tables import appended, as_arrivals, as_stream, final_counts, final_updates, late_groups
from .fixtures import R
from .metric_queries import r6
from .registry import query
from .scoring_queries import CAL, ENERGY, SCORED, SIG

RES = f"{SCORED}, res AS (SELECT *, user_id % 9 AS n_faces_found FROM rs)"


def results(t):
    out = V.score_logits(t.preds_logit, CAL)
    return out.select(
        "ts", F.col("event_id").alias("seq"), "split", "video_id", "calibrated_prob", "has_audio", "ood_flag", "verdict", "logit",
        (F.col("user_id") % 9).cast("int").alias("n_faces_found"),
        F.create_map(F.lit("infer_ms"), F.col("calibrated_prob") * 20000.0, F.lit("total_ms"), F.col("video_score") * 60000.0).alias("latency_ms"),
    )


@query("r1_verdict_counters", "preds_logit", f"WITH {RES} SELECT verdict, count(*) AS n, count(*) FILTER (verdict = 'inconclusive') AS n_abstained, count(*) FILTER (ood) AS n_ood FROM res GROUP BY verdict")
def _(t):
    return final_counts(L.verdict_counts(as_stream(results(t), "ts")))


def _le(values, edges):
    edges = ", ".join(f"{e!r}::DOUBLE" for e in edges) + ", 'infinity'::DOUBLE"
    return f"SELECT le, count(*) FILTER (v <= le) AS n FROM ({values}), (SELECT unnest([{edges}]) AS le) GROUP BY le"


@query("r2_probability_histogram", "preds_logit", f"WITH {RES} {_le('SELECT p AS v FROM res', N.PROB_EDGES)}")
def _(t):
    slots = final_counts(L.slot_counts(as_stream(results(t), "ts"), F.col("calibrated_prob"), N.PROB_EDGES))
    return L.cumulative(slots, N.PROB_EDGES)


@query("r2_stage_histogram", "preds_logit", f"""WITH {RES}, sg AS (SELECT 'infer' AS stage, p * 20000.0::DOUBLE / 1000.0::DOUBLE AS v FROM res UNION ALL SELECT 'total', video_score * 60000.0::DOUBLE / 1000.0::DOUBLE FROM res)
   SELECT stage, le, count(*) FILTER (v <= le) AS n FROM sg, (SELECT unnest([{', '.join(f'{e!r}::DOUBLE' for e in N.STAGE_EDGES)}, 'infinity'::DOUBLE]) AS le) GROUP BY 1, 2""")
def _(t):
    stages = L.stage_seconds(as_stream(results(t), "ts"))
    slots = final_counts(L.slot_counts(stages, F.col("seconds"), N.STAGE_EDGES, ["stage"]))
    return L.cumulative(slots, N.STAGE_EDGES, ["stage"])


_BIN = "least(len(list_filter([{}], lambda e: {{}} >= e)), 9)".format(", ".join(f"{i} * 0.1::DOUBLE" for i in range(1, 10)))
#: Every thirteenth result has no probability: it counts as a row, not as a score.
DRIFT = f"""{RES}, rz AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN NULL ELSE p END AS q FROM res), base AS (SELECT * FROM preds_split WHERE split = 'val'),
  w AS (SELECT * FROM rz WHERE q IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 500), rw AS (SELECT * FROM rz ORDER BY ts DESC, event_id DESC LIMIT 500),
  uw AS (SELECT * FROM uploads ORDER BY ts DESC, seq DESC LIMIT 500),
  cb AS (SELECT i, (SELECT count(*) FROM base WHERE {_BIN.format('video_score')} = i) AS nb, (SELECT count(*) FROM w WHERE {_BIN.format('q')} = i) AS nl FROM (SELECT unnest(range(10)) AS i)),
  sh AS (SELECT (nb + 1e-6::DOUBLE) / (sum(nb) OVER () + 1e-5::DOUBLE) AS b, (nl + 1e-6::DOUBLE) / (sum(nl) OVER () + 1e-5::DOUBLE) AS l FROM cb),
  st AS (SELECT (SELECT sum((l - b) * ln(l / b)) FROM sh) AS psi, (SELECT count(*) FROM w) AS n, (SELECT avg(ood::INT) FROM rz) AS ood_rate,
    (SELECT avg((n_faces_found = 0)::INT) FROM rw) AS no_face, (SELECT avg(has_audio::INT) FROM rw) AS audio, (SELECT avg(has_audio::INT) FROM base) AS base_audio)
  SELECT n AS n_observed, (SELECT count(*) FROM base) AS baseline_n, 'val' AS baseline_source, n >= 50 AS ready, {R('psi', 6)} AS score_psi,
    CASE WHEN n >= 50 THEN CASE WHEN psi > 0.25 THEN 'significant' WHEN psi > 0.1 THEN 'moderate' ELSE 'stable' END END AS score_drift,
    {R('(SELECT avg(q) FROM w)', 6)} AS score_mean_live, {R('audio', 6)} AS audio_rate_live, {R('base_audio', 6)} AS audio_rate_baseline,
    {R('no_face', 6)} AS no_face_rate, (SELECT quantile_cont(n_faces_found, 0.5) FROM rw)::DOUBLE AS median_faces,
    {R('ood_rate', 6)} AS ood_rate, {R("(SELECT avg((verdict = 'inconclusive')::INT) FROM rz)", 6)} AS abstain_rate,
    (SELECT quantile_cont(duration_s, 0.5) FROM uw)::DOUBLE AS median_duration_s, (SELECT quantile_cont(height, 0.5) FROM uw)::DOUBLE AS median_height_px,
    {R('(SELECT avg((height < 360)::INT) FROM uw)', 6)} AS small_video_rate,
    (SELECT string_agg(codec || '=' || n, ',' ORDER BY n DESC, codec) FROM (SELECT codec, count(*) AS n FROM uploads WHERE codec IS NOT NULL GROUP BY codec ORDER BY n DESC, codec LIMIT 5)) AS codecs,
    CASE WHEN n >= 50 THEN array_to_string(list_filter([CASE WHEN psi > 0.25 THEN 'score distribution' END, CASE WHEN ood_rate > 0.3 THEN 'out of distribution' END,
      CASE WHEN no_face > 0.25 THEN 'no face' END, CASE WHEN abs(audio - base_audio) > 0.5 THEN 'audio presence' END], lambda x: x IS NOT NULL), ',') END AS alerts FROM st"""
DRIFT_FLOATS = ["score_psi", "score_mean_live", "audio_rate_live", "audio_rate_baseline", "no_face_rate", "ood_rate", "abstain_rate", "small_video_rate"]


def drift_rows(report):
    flat = F.array_join(F.transform(F.map_entries("codecs"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r6(report.drop("score_mean_baseline").withColumns({"codecs": flat, "alerts": F.array_join("alerts", ",")}), *DRIFT_FLOATS)


def _drift_inputs(t):
    base = N.drift_baseline(t.preds_split.where("split = 'val'"), source="val")
    rows = results(t).withColumn("calibrated_prob", F.when(F.col("seq") % 13 == 0, None).otherwise(F.col("calibrated_prob")))
    return base, rows, t.uploads


@query("r3_drift_stream", "preds_logit uploads", f"WITH {DRIFT}")
def _(t):
    base, rows, ups = _drift_inputs(t)
    return drift_rows(L.DriftMonitor(base).run(as_stream(rows, "ts"), as_stream(ups, "ts")).report())


@query("r3_drift_batch", "preds_logit uploads", f"WITH {DRIFT}")
def _(t):
    base, rows, ups = _drift_inputs(t)
    return drift_rows(N.drift_report(rows, base, ups))


@query("w4_rolling_last_n", "preds_logit", """SELECT dataset, video_id FROM preds_logit QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, event_id DESC) <= 500""")
def _(t):
    return N.last_n(t.preds_logit, ["ts", "event_id"], 500, ["dataset"]).select("dataset", "video_id")


_STATE = """js AS (SELECT job_id, min(updated_us) AS created_us, max(updated_us) AS updated_us, arg_max(state, {'u': updated_us, 's': seq}) AS state,
   arg_max(stage, {'u': updated_us, 's': seq}) AS stage, arg_max(filename, {'u': updated_us, 's': seq}) AS filename FROM changes GROUP BY job_id)"""


@query("r4_job_state_stream", "changes", f"WITH {_STATE} SELECT * FROM js")
def _(t):
    return final_updates(J.latest_state(as_stream(t.changes, "ts")), ["job_id"])


@query("r4_job_upsert", "changes", f"""WITH {_STATE}, fst AS (SELECT job_id, min(updated_us) AS created_us FROM changes WHERE seq % 2 = 0 GROUP BY 1)
   SELECT job_id, fst.created_us, state, stage FROM fst JOIN js USING (job_id)""")
def _(t):
    base = N.job_state(t.changes.where("seq % 2 = 0"))
    return N.upsert_jobs(base, t.changes).select("job_id", "created_us", "state", "stage")


@query("r5_retention_purge", "changes", f"WITH {_STATE} SELECT job_id, filename FROM js WHERE created_us < (SELECT max(updated_us) FROM changes) - 864000000000")
def _(t):
    jobs = N.job_state(t.changes)
    now = t.changes.agg(F.max("updated_us").alias("m")).first()["m"]
    _, expired = N.purge(jobs, now, hours=240)
    return expired.select("job_id", "filename")


@query("r6_queue_depth", "changes", f"WITH {_STATE} SELECT count(*) FILTER (state IN ('queued', 'running')) AS depth FROM js")
def _(t):
    return N.queue_depth(N.job_state(t.changes))


@query("t1_recent_jobs", "changes", f"WITH {_STATE} SELECT job_id, state FROM js ORDER BY created_us DESC, job_id DESC LIMIT 500")
def _(t):
    return N.recent(N.job_state(t.changes), 500).select("job_id", "state")


@query("s18_job_table", "changes", f"WITH {_STATE} SELECT job_id, state, CASE WHEN state = 'done' THEN 'likely_manipulated' END AS verdict, CASE WHEN state = 'done' THEN 0.75::DOUBLE END AS calibrated_prob FROM js")
def _(t):
    from ..session import new_path
    from ..sources.logs import read_jobs

    path = new_path(t.spark, "jobs")
    result = F.when(F.col("state") == "done", F.lit('{"verdict":"likely_manipulated","calibrated_prob":0.75,"model_version":"m1"}'))
    N.job_state(t.changes).withColumn("result", result).write.parquet(path)
    return read_jobs(t.spark, path).select("job_id", "state", "verdict", "calibrated_prob")


@query("r7_progress_feed", "changes", """WITH o AS (SELECT *, lag(state) OVER w AS ps, lag(stage) OVER w AS pg, count(*) FILTER (state IN ('done', 'failed', 'cancelled')) OVER (PARTITION BY job_id ORDER BY updated_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over
     FROM changes WINDOW w AS (PARTITION BY job_id ORDER BY updated_us, seq)) SELECT job_id, seq, state, stage FROM o WHERE over = 0 AND (ps IS NULL OR ps <> state OR pg <> stage)""")
def _(t):
    return appended(J.progress_feed(by_week(t.changes)))


def by_week(rows, delayed=None):
    """A stream of weekly micro-batches; rows that ``delayed`` names come two weeks late."""
    week = F.floor((F.unix_micros("ts") - F.lit(rows.agg(F.min(F.unix_micros("ts"))).first()[0] or 0)) / 604_800_000_000)
    late = F.lit(0) if delayed is None else F.when(delayed, 2).otherwise(0)
    return as_arrivals(rows.withColumn("arrival", week + late), "arrival")


#: Every fortieth request comes two weeks late. A batch drops the windows that ended
#: before the watermark of the batch before it; at the end, closed windows are out.
_ARRIVALS = """a AS (SELECT *, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 604800000000) + CASE WHEN seq % 40 = 0 THEN 2 ELSE 0 END AS arrival FROM requests),
   d AS (SELECT *, dense_rank() OVER (ORDER BY arrival) AS k, date_trunc('hour', ts) AS start FROM a),
   m AS (SELECT k, max(ts) AS top FROM d GROUP BY k),
   wm AS (SELECT k, max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 10 MINUTE AS w FROM m),
   r AS (SELECT *, coalesce(start + INTERVAL 1 HOUR <= w, false) AS late, start + INTERVAL 1 HOUR <= max(ts) OVER () - INTERVAL 10 MINUTE AS closed FROM d JOIN wm USING (k))"""


@query("r8_rate_breaches", "requests", f"WITH {_ARRIVALS} SELECT client, start::VARCHAR AS start, count(*) AS n FROM r WHERE closed AND NOT late GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    out = appended(L.rate_windows(by_week(t.requests, F.col("seq") % 40 == 0), 60, limit=1))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("r8_late_windows", "requests", f"WITH {_ARRIVALS} SELECT count(DISTINCT (client, start, k)) FILTER (late) AS late_windows, (SELECT count(*) FROM (SELECT DISTINCT client, start FROM r WHERE closed AND NOT late)) AS closed_windows FROM r")
def _(t):
    ran = []
    out = appended(L.rate_windows(by_week(t.requests, F.col("seq") % 40 == 0), 60), ran)
    return out.agg(F.count(F.lit(1)).alias("closed_windows")).select(F.lit(late_groups(ran[0])).cast("long").alias("late_windows"), "closed_windows")


@query("r8_rate_breaches_batch", "requests", "SELECT client, date_trunc('hour', ts)::VARCHAR AS start, count(*) AS n FROM requests GROUP BY 1, 2 HAVING count(*) > 2")
def _(t):
    return N.rate_breaches(t.requests, 2, 60).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


POLICY = """pol AS (SELECT *, CASE WHEN size_bytes > 104857600 THEN 'too_large' WHEN duration_s IS NULL THEN 'undecodable' WHEN duration_s > 60 THEN 'too_long'
   WHEN least(width, height) < 64 THEN 'other' WHEN codec NOT IN ('h264', 'hevc', 'vp8', 'vp9', 'av1', 'mpeg4', 'mjpeg', 'theora') THEN 'other' END AS reason FROM uploads)"""


@query("r9_upload_rejects", "uploads", f"WITH {POLICY} SELECT reason, count(*) AS n FROM pol WHERE reason IS NOT NULL GROUP BY reason")
def _(t):
    return final_counts(L.reject_counts(as_stream(t.uploads, "ts")))


@query("p4_upload_policy", "uploads", f"WITH {POLICY} SELECT upload_id, reason FROM pol")
def _(t):
    from ..functions.media import upload_policy

    return upload_policy(t.uploads).select("upload_id", "reason")


@query("t3_top_codecs", "uploads", "SELECT codec, count(*) AS n FROM uploads GROUP BY codec ORDER BY n DESC, codec LIMIT 5")
def _(t):
    return N.top_codecs(t.uploads)


@query("r10_stream_scoring", "preds_logit", f"WITH {RES} SELECT video_id, verdict, {R('p', 6)} AS calibrated_prob FROM res")
def _(t):
    feed = as_stream(t.preds_logit.select("ts", "video_id", "logit"), "ts")
    out = appended(V.score_logits(feed, CAL).select("video_id", "verdict", "calibrated_prob"))
    return r6(out, "calibrated_prob")


@query("r11_epoch_tail", "epochs", """WITH b AS (SELECT run, count(*) AS epochs, max({'v': val_auc, 'e': -epoch}) AS best, max(epoch) AS last FROM epochs GROUP BY run)
   SELECT run, epochs, round(best.v, 4) AS best, -best.e AS best_epoch, last + best.e AS stalled_epochs FROM b""")
def _(t):
    tail = final_counts(J.epoch_tail(as_stream(t.epochs, "epoch")))
    best = -F.col("best.e")
    return tail.select("run", "epochs", F.round("best.val_auc", 4).alias("best"), best.alias("best_epoch"), (F.col("last") - best).alias("stalled_epochs"))


@query("q12_live_monitor", "preds_logit uploads changes requests", f"""WITH {RES}, {POLICY}, {_STATE}, {_ARRIVALS}
   SELECT 'verdict' AS metric, verdict AS key, count(*) AS n FROM res GROUP BY verdict
   UNION ALL SELECT 'abstained', 'all', count(*) FILTER (verdict = 'inconclusive') FROM res UNION ALL SELECT 'ood', 'all', count(*) FILTER (ood) FROM res
   UNION ALL SELECT 'probability', le::VARCHAR, n FROM ({_le('SELECT p AS v FROM res', N.PROB_EDGES)}) WHERE le <= 1
   UNION ALL SELECT 'job', state, count(*) FROM js GROUP BY state UNION ALL SELECT 'queue', 'depth', count(*) FILTER (state IN ('queued', 'running')) FROM js
   UNION ALL SELECT 'rate', client::VARCHAR, count(*) FROM (SELECT client, start FROM r WHERE closed AND NOT late GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY client
   UNION ALL SELECT 'reject', reason, count(*) FROM pol WHERE reason IS NOT NULL GROUP BY reason
   UNION ALL SELECT 'scored', 'all', count(*) FROM res""")
def _(t):
    """Verdicts, novelty, probabilities, jobs, queue, rate breaches, rejects and scored clips, each from its stream."""
    feed = results(t)
    counts = final_counts(L.verdict_counts(as_stream(feed, "ts")))
    slots = final_counts(L.slot_counts(as_stream(feed, "ts"), F.col("calibrated_prob"), N.PROB_EDGES))
    jobs = final_updates(J.latest_state(as_stream(t.changes, "ts")), ["job_id"])
    breaches = appended(L.rate_windows(by_week(t.requests, F.col("seq") % 40 == 0), 60, limit=1))
    rejects = final_counts(L.reject_counts(as_stream(t.uploads, "ts")))
    scored = appended(V.score_logits(as_stream(t.preds_logit.select("ts", "video_id", "logit"), "ts"), CAL).select("video_id"))

    def rows(df, metric, key, n="n"):
        return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))

    count = F.count(F.lit(1)).alias("n")
    parts = [
        rows(counts, "verdict", F.col("verdict")),
        rows(counts.agg(F.coalesce(F.sum("n_abstained"), F.lit(0)).alias("n")), "abstained", F.lit("all")),
        rows(counts.agg(F.coalesce(F.sum("n_ood"), F.lit(0)).alias("n")), "ood", F.lit("all")),
        rows(L.cumulative(slots, N.PROB_EDGES).where("le <= 1"), "probability", F.col("le")),
        rows(jobs.groupBy("state").agg(count), "job", F.col("state")),
        rows(N.queue_depth(jobs), "queue", F.lit("depth"), "depth"),
        rows(breaches.groupBy("client").agg(count), "rate", F.col("client")),
        rows(rejects, "reject", F.col("reason")),
        rows(scored.agg(count), "scored", F.lit("all")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


VAR = """sv AS (SELECT video_id, variant, prob, error, CASE WHEN prob >= 0.35 AND prob <= 0.45 THEN 'inconclusive' WHEN prob >= 0.4 THEN 'likely_manipulated' ELSE 'likely_authentic' END AS verdict FROM variants),
  ov AS (SELECT video_id, verdict AS ov, prob AS op FROM sv WHERE variant = 'orig'),
  st AS (SELECT video_id, any_value(ov) AS original_verdict, any_value(op) AS op, count(*) FILTER (variant <> 'orig' AND error = '') AS n_scored, count(*) FILTER (variant <> 'orig' AND error <> '') AS n_failed,
    count(*) FILTER (variant <> 'orig' AND error = '' AND verdict = ov) AS same, max(prob) FILTER (variant <> 'orig' AND error = '') AS hi, min(prob) FILTER (variant <> 'orig' AND error = '') AS lo
    FROM sv JOIN ov USING (video_id) GROUP BY video_id)"""


def _variants(t):
    verdict = V.verdict("prob", F.col("prob").between(0.35, 0.45), F.lit(False), 0.4)
    return t.variants.withColumn("verdict", verdict)


@query("a18_clip_stability", "variants", f"""WITH {VAR} SELECT video_id, original_verdict, n_scored, n_failed, {R('CASE WHEN n_scored > 0 THEN same / n_scored ELSE 0 END', 4)} AS verdict_agreement,
   {R('greatest(op, coalesce(hi, op)) - least(op, coalesce(lo, op))', 4)} AS prob_spread, n_scored > 0 AND same = n_scored AND greatest(op, hi) - least(op, lo) <= 0.15 AS stable FROM st""")
def _(t):
    return N.stability(_variants(t))


@query("x4_variant_scorer", "variants", f"""WITH z AS (SELECT video_id, variant, error, prob * 4 - 2 AS logit FROM variants), sc AS (SELECT *, {SIG('logit / 1.7::DOUBLE')} AS p, {ENERGY} AS e FROM z),
   vd AS (SELECT video_id, variant, error, CASE WHEN error <> '' THEN 0 ELSE p END AS prob, CASE WHEN error <> '' THEN 'error' WHEN (p >= 0.35 AND p <= 0.45) OR e > -0.75 THEN 'inconclusive' WHEN p >= 0.4 THEN 'likely_manipulated' ELSE 'likely_authentic' END AS verdict FROM sc),
   o AS (SELECT video_id, verdict AS ov, prob AS op FROM vd WHERE variant = 'orig'),
   st AS (SELECT video_id, any_value(op) AS op, any_value(ov) AS ov, count(*) FILTER (variant <> 'orig' AND error = '') AS n_scored, count(*) FILTER (variant <> 'orig' AND error <> '') AS n_failed,
     count(*) FILTER (variant <> 'orig' AND error = '' AND verdict = ov) AS same, max(prob) FILTER (variant <> 'orig' AND error = '') AS hi, min(prob) FILTER (variant <> 'orig' AND error = '') AS lo FROM vd JOIN o USING (video_id) GROUP BY video_id)
   SELECT n_scored > 0 AND same = n_scored AND greatest(op, hi) - least(op, lo) <= 0.15 AS stable, count(*) AS n, sum(n_failed)::BIGINT AS n_failed FROM st GROUP BY 1""")
def _(t):
    from ..operators.scoring import batch_verdicts

    def predict(pdf):
        if (pdf["error_planned"] != "").any():
            raise ValueError("cannot decode")
        return {"logit": pdf["z"].to_numpy()}

    clips = t.variants.select("video_id", "variant", F.col("error").alias("error_planned"), (F.col("prob") * 4 - 2).alias("z"))
    out = batch_verdicts(clips, predict, CAL, ["video_id", "variant"])
    s = N.stability(out.withColumn("prob", F.coalesce("calibrated_prob", F.lit(0.0))))
    return s.groupBy("stable").agg(F.count(F.lit(1)).alias("n"), F.sum("n_failed").alias("n_failed"))


@query("x2_batch_scorer", "preds", """SELECT CASE WHEN event_id % 97 = 0 THEN 'error' ELSE 'ok' END AS outcome, count(*) AS n FROM preds GROUP BY 1""")
def _(t):
    from ..operators.scoring import score

    def predict(pdf):
        if (pdf["event_id"] % 97 == 0).any():
            raise ValueError("cannot decode")
        return {"logit": pdf["video_score"].to_numpy()}

    out = score(t.preds.select("video_id", "event_id", "video_score"), predict)
    return out.groupBy(F.when(F.col("error") == "", "ok").otherwise("error").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_batch_verdict_counts", "preds_logit", f"WITH {RES} SELECT CASE WHEN event_id % 97 = 0 THEN 'error' ELSE verdict END AS verdict, count(*) AS n FROM res GROUP BY 1")
def _(t):
    from ..operators.scoring import batch_verdicts

    def predict(pdf):
        if (pdf["event_id"] % 97 == 0).any():
            raise ValueError("cannot decode")
        return {"logit": pdf["z"].to_numpy()}

    clips = t.preds_logit.select("video_id", "event_id", F.col("logit").alias("z"))
    return N.verdict_counts(batch_verdicts(clips, predict, CAL, ["video_id"]))


@query("a25_drift_baseline", "preds_split", f"""SELECT {R('avg(video_score)', 6)} AS score_mean, {R('avg(has_audio::INT)', 6)} AS audio_rate, count(*) AS n FROM preds_split WHERE split = 'val'""")
def _(t):
    b = N.drift_baseline(t.preds_split.where("split = 'val'"))
    return b.select(half_up("score_mean", 6).alias("score_mean"), half_up("audio_rate", 6).alias("audio_rate"), "n")


@query("f14_job_progress", "changes", """SELECT seq, round(CASE stage WHEN 'queued' THEN 0 WHEN 'probe' THEN 1 WHEN 'infer' THEN 3 WHEN 'done' THEN 7 ELSE 0 END / 7, 6) AS progress FROM changes""")
def _(t):
    return t.changes.select("seq", F.round(V.job_progress("stage"), 6).alias("progress"))
