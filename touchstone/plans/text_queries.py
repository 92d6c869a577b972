"""Queries over text, results, uploads and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, text as X
from ..functions import verdicts as V
from ..functions.hashing import fingerprint, record_hash, sample_seed, sorted_json
from ..functions.numeric import half_up
from ..operators import diagnose as G
from ..operators import manifest as MF
from ..operators import sampling
from ..sources import manifests as S
from .fixtures import H, R
from .metric_queries import EER_THR, r6, roc_sql
from .registry import query


def _docs(t):
    return t.documents.select("doc_id", "text")


NUM = lambda x: f"regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '\\.$', '')"


@query("p8_grounding", "", rf"""WITH n AS (SELECT doc_id, text, n_chars, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?') AS nums FROM documents),
   c AS (SELECT doc_id,
     regexp_matches(text, '(?i)\b(definitely|certainly|clearly|undoubtedly|obviously|proves?|proven|confirms?|confirmed|guarantee[sd]?|without doubt|100%|conclusive(ly)?)\b') AS certain,
     regexp_matches(text, '(?i)\b(this person|the person in|the subject is|he |she |his |her |deliberately|intentionally|malicious|fraudster|scammer|created by|in order to deceive|trying to)\b') AS blame,
     len(list_filter(list_transform(nums, lambda x: {NUM('x::DOUBLE')}), lambda v: NOT list_contains(list_concat(list_transform(range(0, 65), lambda i: i::VARCHAR), ['0.78', '0.8', '78']), v))) > 0 AS invented,
     len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 130 AS long, length(trim(text)) < 20 AS short FROM n)
   SELECT doc_id, certain, blame, invented, long, short FROM c""")
def _(t):
    reasons = X.grounding("text", F.array(F.lit(0.78)), F.lit(False))
    has = lambda r: F.exists("r", lambda x: x.startswith(r))
    return _docs(t).select("doc_id", reasons.alias("r")).select(
        "doc_id", has("certainty").alias("certain"), has("person").alias("blame"), has("unknown numbers").alias("invented"),
        has("over the word limit").alias("long"), has("hardly any text").alias("short"),
    )


@query("p9_overclaims", "", r"""WITH m AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g'), '(?i)\b(solves?|solved|robust to all|state[- ]of[- ]the[- ]art|significantly outperforms|proves?|guarantees?|eliminates?|fully generaliz|completely|the|le|der)\b') AS hits FROM documents)
   SELECT doc_id, lower(u.phrase) AS phrase, count(*) AS n FROM m, LATERAL (SELECT unnest(hits) AS phrase) u GROUP BY 1, 2""")
def _(t):
    # Three frequent words join the list so that the scan has hits on invented prose.
    pattern = X.OVERCLAIM.replace("completely", "completely|the|le|der")
    hits = X.overclaims(_docs(t), "doc_id", pattern=pattern)
    return hits.groupBy("doc_id", F.lower("phrase").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("p9_overclaim_lines", "", r"""WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS no FROM (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g') AS x FROM documents))
   SELECT doc_id, no::INT AS line, len(regexp_extract_all(line, '(?i)\b(the|le|der)\b')) AS n FROM l WHERE regexp_matches(line, '(?i)\b(the|le|der)\b')""")
def _(t):
    hits = X.overclaims(_docs(t), "doc_id", pattern=r"(?i)\b(the|le|der)\b")
    return hits.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query("p10_banned_tokens", "", """SELECT DISTINCT doc_id, token FROM documents, (SELECT unnest(['bark', 'rvc', 'tts', 'license', 'copyright', 'email', 'diffusers']) AS token) WHERE contains(lower(text), token)""")
def _(t):
    return X.banned_tokens(_docs(t), "doc_id", ["bark", "rvc", "TTS", "license", "copyright", "email", "diffusers"])


@query("p10_banned_imports", "", r"""SELECT DISTINCT doc_id, u.token FROM documents, LATERAL (SELECT unnest(regexp_extract_all('x = 1' || chr(10) || '  import ' || lang || 'lib' || chr(10) || text, '(?m)^\s*(?:import|from)\s+(enlib|frlib)\b', 1)) AS token) u""")
def _(t):
    code = F.concat(F.lit("x = 1\n  import "), F.col("lang"), F.lit("lib\n"), F.col("text"))
    return X.banned_imports(t.documents.select("doc_id", code.alias("text")), "doc_id", ["enlib", "frlib"])


DIVERGED = r"""WITH g AS (SELECT source AS run, CASE doc_id % 3 WHEN 0 THEN 'metrics.jsonl' WHEN 1 THEN 'train.log' ELSE 'stderr.log' END AS name, doc_id, text || CASE WHEN doc_id % 50 = 1 THEN ' Traceback' WHEN doc_id % 70 = 2 THEN ' loss nan' ELSE '' END AS tail FROM documents),
   r AS (SELECT run || '/' || doc_id AS run, name, CASE WHEN regexp_matches(tail, '(?i)non-?finite loss') THEN 'non-finite loss' WHEN regexp_matches(tail, '(?i)\bnan\b') THEN 'NaN in the logs'
     WHEN regexp_matches(tail, '(?i)CUDA out of memory') THEN 'CUDA OOM' WHEN regexp_matches(tail, '(?i)Traceback') THEN 'unhandled exception' END AS reason FROM g)
   SELECT run, reason, name AS source FROM r WHERE reason IS NOT NULL"""


def logged(t):
    """Log files of runs, some of which went wrong."""
    d = F.col("doc_id")
    tail = F.when(d % 50 == 1, " Traceback").when(d % 70 == 2, " loss nan").otherwise("")
    name = F.when(d % 3 == 0, "metrics.jsonl").when(d % 3 == 1, "train.log").otherwise("stderr.log")
    return t.documents.select(F.concat_ws("/", "source", d.cast("string")).alias("run"), name.alias("name"), F.concat("text", tail).alias("text"))


@query("p11_log_divergence", "", DIVERGED)
def _(t):
    return X.divergence(logged(t))


def _even(d: int) -> str:
    """Half-even quotient of the integer ``k`` by ``d``."""
    return f"(k // {d} + CASE WHEN k % {d} * 2 > {d} OR (k % {d} * 2 = {d} AND k // {d} % 2 = 1) THEN 1 ELSE 0 END)"


@query("f9_licensed_numbers", "preds", f"""SELECT video_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([k / 10000, {_even(100)} / 100, {_even(1000)} / 10, {_even(100)}, {_even(10)} / 10],
   lambda v: {NUM('v')}), lambda s: NOT list_contains(list_transform(range(0, 65), lambda i: i::VARCHAR), s)))), ' ') AS extra FROM (SELECT video_id, round(video_score * 10000)::BIGINT AS k FROM preds)""")
def _(t):
    small = F.lit([str(i) for i in range(65)])
    extra = F.array_sort(F.array_except(X.licensed_numbers(F.array("video_score")), small))
    return t.preds.select("video_id", F.array_join(extra, " ").alias("extra"))


# ---- result rows --------------------------------------------------------------
def results(t):
    """One nested result per clip of ``frames``."""
    fs = F.sort_array(F.collect_list(F.struct("ts_s", "event_id", "score")))
    base = t.frames.groupBy("clip").agg(fs.alias("f"))
    k = F.col("clip")
    prob = (k % 97) / 97.0
    streams = V.stream_evidence(
        F.create_map(F.lit("visual"), prob - 0.5, F.lit("audio"), prob * 2 - 1, F.lit("sync"), F.lit(0.25)),
        k % 3 != 0, k % 4 != 0, F.create_map(F.lit("visual"), F.lit(0.5), F.lit("audio"), F.lit(0.3)),
    )
    return base.select(
        k.cast("string").alias("video_id"),
        F.lit("m1").alias("model_version"),
        F.when(k % 5 == 0, "inconclusive").when(prob >= 0.4, "likely_manipulated").otherwise("likely_authentic").alias("verdict"),
        prob.alias("calibrated_prob"),
        F.lit(0.35).alias("conformal_lo"),
        F.lit(0.45).alias("conformal_hi"),
        prob.alias("raw_score"),
        F.lit(0.3).alias("threshold"),
        streams.alias("streams"),
        F.transform("f", lambda x: x["score"]).alias("frame_scores"),
        F.transform("f", lambda x: x["ts_s"]).alias("frame_timestamps"),
        F.transform("f", lambda x: x["score"] / 2).alias("sync_curve"),
        F.lit(None).cast("double").alias("sync_offset_ms"),
        F.create_map(F.lit("visual"), F.lit(0.5), F.lit("audio"), F.lit(0.3)).alias("gate_weights"),
        (k % 7 == 0).alias("ood_flag"),
        (k % 3 != 0).alias("has_audio"),
        (k % 9).cast("int").alias("n_faces_found"),
        F.create_map(F.lit("audio_snr"), F.lit(0.4)).alias("reliability"),
        V.result_warnings(V.preprocess_warnings(F.lit("(0.6, 0.7, 0.7)"), k % 9, k % 3 != 0), k % 11 == 0, k % 9).alias("warnings"),
        F.lit(None).cast("string").alias("explanation"),
        F.lit(None).cast("string").alias("explanation_source"),
        F.create_map(F.lit("total_ms"), F.lit(12.0)).alias("latency_ms"),
        (k % 11 == 0).alias("calibration_degenerate"),
    )


_VERDICT = "CASE WHEN clip % 5 = 0 THEN 'inconclusive' WHEN (clip % 97) / 97.0::DOUBLE >= 0.4 THEN 'likely_manipulated' ELSE 'likely_authentic' END"
_SEGS = """o AS (SELECT *, row_number() OVER w AS i, lag(score) OVER w AS pv FROM frames WINDOW w AS (PARTITION BY clip ORDER BY ts_s, event_id)),
  sg AS (SELECT clip, count(*) FILTER (score >= 0.3 AND coalesce(pv < 0.3, true)) AS n_seg, max(score) AS peak, min(score) AS low, count(*) AS n, arg_max(ts_s, {'s': score, 'r': -i}) AS peak_ts, avg(score / 2) AS sync FROM o GROUP BY clip)"""
_NWARN = "((clip % 9 = 0)::INT + (clip % 3 = 0)::INT + (clip % 11 = 0)::INT + (clip % 9 = 0)::INT)"


@query("f11_summary_row", "frames", f"""WITH {_SEGS} SELECT clip::VARCHAR AS video_id, {_VERDICT} AS verdict, {R('(clip % 97) / 97.0::DOUBLE', 4)} AS calibrated_prob, clip % 7 = 0 AS ood_flag, clip % 11 <> 0 AS calibration_reliable,
   clip % 3 <> 0 AS has_audio, (clip % 9)::INT AS n_faces_found, n_seg AS n_suspicious_segments, {R('peak', 6)} AS peak_frame_score, {_NWARN} AS n_warnings, 'm1' AS model_version FROM sg""")
def _(t):
    return r6(V.summary(results(t)).drop("conformal_lo", "conformal_hi", "threshold"), "peak_frame_score")


@query("p14_public_result", "frames", f"""WITH {_SEGS} SELECT clip::VARCHAR AS video_id, {_VERDICT} AS verdict, {R('(clip % 97) / 97.0::DOUBLE', 4)} AS calibrated_probability, clip % 5 = 0 AS abstained,
   clip % 11 <> 0 AS calibration_reliable, n_seg AS n_segments, 0.35::DOUBLE AS ci_low FROM sg""")
def _(t):
    p = V.public_result(results(t))
    return p.select("video_id", "verdict", "calibrated_probability", "abstained", "calibration_reliable", F.size("suspicious_segments").alias("n_segments"), F.col("confidence_interval")[0].alias("ci_low"))


@query("f12_explain_payload", "frames", f"""WITH {_SEGS} SELECT clip::VARCHAR AS video_id, n AS n_frames, {R('low', 4)} AS lo, {R('peak', 4)} AS hi, {R('peak_ts', 3)} AS peak_ts, {R(R('sync', 4), 3)} AS sync FROM sg""")
def _(t):
    p = V.explain_payload(results(t))
    return p.select("video_id", F.col("payload.n_frames_scored").alias("n_frames"), F.col("payload.frame_score_min").alias("lo"), F.col("payload.frame_score_max").alias("hi"),
                    half_up("payload.peak_frame_time_s", 3).alias("peak_ts"), half_up("payload.sync_curve_mean", 3).alias("sync"))


_PCT = "printf('%.0f', calp * 100) || '%'"


@query("f13_template_text", "frames", f"""WITH {_SEGS}, b AS (SELECT *, {R('(clip % 97) / 97.0::DOUBLE', 4)} AS calp, {R('peak', 4)} AS hi FROM sg)
   SELECT clip::VARCHAR AS video_id, CASE WHEN clip % 9 = 0 THEN 'No face' WHEN clip % 7 = 0 THEN 'No verdict: uncertain, as the clip looks unlike anything in the training data. Raw estimate: ' || {_PCT} || '.'
     WHEN clip % 5 = 0 THEN 'No verdict: uncertain, as its score lies between the two limits of the undecided range. Raw estimate: ' || {_PCT} || '.'
     WHEN (clip % 97) / 97.0::DOUBLE >= 0.4 THEN 'Manipulation is likely: ' || {_PCT} || ' by the detector''s estimate.'
     ELSE 'No sign of manipulation above the threshold: ' || {_PCT} || ' by the detector''s estimate.' END AS opening FROM b""")
def _(t):
    p = V.explain_payload(results(t)).select("video_id", X.template_text().alias("text"))
    opening = F.when(F.col("text").startswith("There was no face"), "No face").otherwise(F.regexp_extract("text", r"^(.*?)(?: Highest frame score| Without a sound track| Lip sync, with|$)", 1))
    return p.select("video_id", opening.alias("opening"))


@query("f13_served_text")
def _(t):
    p = V.explain_payload(results(t)).withColumn("text", F.concat(F.lit("The estimate is "), F.format_string("%.4f", "payload.calibrated_probability"), F.lit(" here, with 71.5 frames.")))
    return X.check_explanations(p).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("f20_stream_evidence", "frames", f"""WITH c AS (SELECT DISTINCT clip, (clip % 97) / 97.0::DOUBLE AS p FROM frames), s AS (SELECT clip, p, unnest(['visual', 'audio', 'sync']) AS name FROM c)
   SELECT clip::VARCHAR AS video_id, name, CASE WHEN name = 'visual' OR clip % 3 <> 0 THEN {R("1.0::DOUBLE / (1.0::DOUBLE + exp(-(CASE name WHEN 'visual' THEN p - 0.5::DOUBLE WHEN 'audio' THEN p * 2 - 1 ELSE 0.25::DOUBLE END)))", 5)} END AS score,
   name = 'visual' OR clip % 3 <> 0 AS available, CASE name WHEN 'visual' THEN 0.5::DOUBLE WHEN 'audio' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS reliability,
   CASE WHEN name <> 'visual' AND clip % 3 = 0 THEN 'no audio track; stream masked off' WHEN name = 'sync' AND clip % 4 = 0 THEN 'mouth region not reliably visible' ELSE '' END AS note FROM s""")
def _(t):
    return results(t).select("video_id", F.inline("streams"))


@query("f21_warning_list", "frames", """WITH c AS (SELECT DISTINCT clip FROM frames) SELECT clip::VARCHAR AS video_id, (clip % 9 = 0)::INT + (clip % 3 = 0)::INT AS n_meta, (clip % 11 = 0)::INT + (clip % 9 = 0)::INT AS n_result FROM c""")
def _(t):
    r = results(t)
    own = F.filter("warnings", lambda w: w.isin(V.DEGENERATE_WARNING, V.NO_FACE_WARNING))
    return r.select("video_id", (F.size("warnings") - F.size(own)).alias("n_meta"), F.size(own).alias("n_result"))


# ---- hashes and names -----------------------------------------------------------
@query("f3_sample_seed", "manifest", """SELECT video_id, ('0x' || substr(sha256(video_id || ':3'), 1, 8))::BIGINT AS seed FROM manifest""")
def _(t):
    return t.manifest.select("video_id", sample_seed("video_id", 3).alias("seed"))


@query("f4_record_hash", "manifest", """SELECT video_id, substr(sha256('{"dataset":"' || dataset || '","label":' || label || ',"split":"' || split || '"}'), 1, 12) AS hash FROM manifest""")
def _(t):
    body = sorted_json({"split": "split", "dataset": "dataset", "label": "label"})
    return t.manifest.select("video_id", record_hash(body, 12).alias("hash"))


@query("f5_fingerprint", "", "SELECT doc_id, sha256(encode(text) || encode(strlen(text)::VARCHAR)) AS hash FROM documents")
def _(t):
    content = F.encode("text", "utf-8")
    return t.documents.select("doc_id", fingerprint(content, F.octet_length("text")).alias("hash"))


@query("f1_identity_keys", "manifest", """SELECT video_id, 'dfo_' || CASE WHEN a < b THEN a || '+' || b WHEN a > b THEN b || '+' || a ELSE a END AS who FROM (SELECT video_id, source_identity AS a, 'c' || (length(path) * 7) AS b FROM manifest)""")
def _(t):
    other = F.concat(F.lit("c"), (F.length("path") * 7).cast("string"))
    return t.manifest.select("video_id", S.pair_key("dfo_", F.array("source_identity", other)).alias("who"))


@query("f2_method_tags", "manifest", """SELECT video_id, CASE k WHEN 0 THEN 'dfo_level' || (length(video_id) % 5) WHEN 1 THEN 'dfo_blur' WHEN 2 THEN 'dfo_end_to_end' ELSE 'dfo_reenact' END AS tag,
   CASE WHEN label = 0 THEN 'real' WHEN has_audio AND fps > 20 THEN 'lavdf_both' WHEN NOT has_audio AND fps > 20 THEN 'lavdf_audio' WHEN has_audio THEN 'lavdf_video' ELSE 'lavdf_unknown' END AS method
   FROM (SELECT *, substr(video_id, 2)::BIGINT % 4 AS k FROM manifest)""")
def _(t):
    k = F.substring("video_id", 2, 20).cast("bigint") % 4
    folder = F.when(k == 0, F.concat(F.lit("end_to_end_level_"), (F.length("video_id") % 5).cast("string"))).when(k == 1, "end_to_end_blur").when(k == 2, "end_to_end").otherwise("reenact")
    return t.manifest.select("video_id", S.deeperforensics_tag(folder).alias("tag"), S.lavdf_method("has_audio", F.col("fps") > 20, "label").alias("method"))


@query("f15_config_flatten", "manifest", """SELECT dataset AS "data.name", array_to_string([1, 2], ',') AS "data.seeds", count(*) AS n FROM manifest GROUP BY dataset""")
def _(t):
    cfg = F.struct(F.struct(F.col("dataset").alias("name"), F.array(F.lit(1), F.lit(2)).alias("seeds")).alias("data"), F.col("fps").alias("fps"))
    return media.flatten_config(t.manifest.select("video_id", cfg.alias("cfg")), "cfg").groupBy("`data.name`", "`data.seeds`").agg(F.count(F.lit(1)).alias("n"))


@query("f16_probe_repair", "manifest", f"""SELECT path, CASE k WHEN 0 THEN 29.97::DOUBLE WHEN 1 THEN 24.0::DOUBLE ELSE 25.0::DOUBLE END AS fps,
   CASE WHEN k = 3 THEN n_frames::BIGINT ELSE greatest(floor(duration_s * CASE k WHEN 0 THEN 2997 / 100.0::DOUBLE WHEN 1 THEN 24 / 1.0::DOUBLE ELSE 25 END)::BIGINT, 1) END AS n_frames,
   {R('CASE WHEN k = 3 THEN n_frames / 25.0::DOUBLE ELSE duration_s END', 3)} AS duration_s, has_audio FROM (SELECT *, substr(video_id, 2)::BIGINT % 4 AS k FROM manifest)""")
def _(t):
    k = F.substring("video_id", 2, 20).cast("bigint") % 4
    rate = F.when(k == 0, "2997/100").when(k == 1, "0/0").otherwise("bad")
    probe = F.to_json(F.struct(
        rate.alias("avg_frame_rate"), F.when(k == 1, "24/1").otherwise("0/0").alias("r_frame_rate"),
        F.when(k != 3, F.col("duration_s").cast("string")).alias("format_duration"), F.when(k == 3, F.col("n_frames").cast("string")).alias("nb_frames"),
        F.when(F.col("has_audio"), "2").otherwise("0").alias("audio_channels"),
    ))
    return media.repair_probe(t.manifest.select("path", probe.alias("probe")))


@query("f19_domain_ids", "preds", """WITH f AS (SELECT forgery_method AS value, min(event_id) AS m FROM preds GROUP BY 1) SELECT value, row_number() OVER (ORDER BY m) - 1 AS id FROM f""")
def _(t):
    early = MF.domain_ids(t.preds.where("event_id < 3"), "forgery_method", "event_id")
    return MF.domain_ids(t.preds, "forgery_method", "event_id", early)


@query("p5_container_sniff", "", """SELECT doc_id, substr(CASE doc_id % 4 WHEN 0 THEN 'RIFF' WHEN 1 THEN 'xxxxftyp' WHEN 2 THEN 'FLV' ELSE '' END || text, 1, 4) = 'RIFF' OR substr(CASE doc_id % 4 WHEN 0 THEN 'RIFF' WHEN 1 THEN 'xxxxftyp' WHEN 2 THEN 'FLV' ELSE '' END || text, 5, 4) = 'ftyp'
   OR substr(CASE doc_id % 4 WHEN 0 THEN 'RIFF' WHEN 1 THEN 'xxxxftyp' WHEN 2 THEN 'FLV' ELSE '' END || text, 1, 3) = 'FLV' AS known FROM documents""")
def _(t):
    d = F.col("doc_id") % 4
    head = F.when(d == 0, "RIFF").when(d == 1, "xxxxftyp").when(d == 2, "FLV").otherwise("")
    return t.documents.select("doc_id", media.sniff(F.encode(F.concat(head, F.col("text")), "utf-8")).alias("known"))


@query("p6_read_policy", "manifest", """SELECT video_id, CASE WHEN label = 1 THEN '' ELSE array_to_string(list_filter([CASE WHEN split NOT IN ('train', 'val') THEN 'split not readable' END, CASE WHEN video_id LIKE '%7' THEN 'looks like a test artefact' END,
   CASE WHEN dataset <> 'ffpp' THEN 'target domain' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM manifest""")
def _(t):
    path = F.concat(F.lit("/runs/preds_"), F.when(F.col("video_id").endswith("7"), "Test").otherwise("x"), F.lit(".csv"))
    req = t.manifest.select("video_id", "split", "dataset", path.alias("path"), F.when(F.col("label") == 1, "human").otherwise("a4_failure").alias("agent"))
    return media.read_policy(req, "ffpp").select("video_id", F.array_join("reasons", "; ").alias("reasons"))


# ---- diagnosis -------------------------------------------------------------------
JUDGED = """j AS (SELECT *, (video_score >= 0.3)::INT = label AS ok, (video_score >= 0.25 AND video_score <= 0.35) AS abstain FROM preds_split)"""


def _judged(t):
    return G.judged(t.preds_split.withColumn("abstain", F.col("video_score").between(0.25, 0.35)), 0.3, "video_score")


@query("a13_slice_accuracy", "preds_split", f"""WITH {JUDGED}, l AS (SELECT ok, unnest(['forgery_method', 'compression', 'dataset', 'has_audio']) AS axis, unnest([forgery_method, compression, dataset, has_audio::VARCHAR]) AS value FROM j),
   s AS (SELECT axis, value, count(*) AS n, avg(ok::INT) AS acc FROM l GROUP BY 1, 2 HAVING count(*) >= 5), o AS (SELECT avg(ok::INT) AS overall FROM j)
   SELECT axis, value, n, {R('acc', 6)} AS accuracy, {R('overall', 6)} AS overall, acc = min(acc) OVER (PARTITION BY axis) AND overall - acc > 0.1 AS flagged FROM s, o""")
def _(t):
    return r6(G.slice_accuracy(_judged(t)), "accuracy", "overall")


@query("a14_quartile_accuracy", "preds_split", f"""WITH {JUDGED}, q AS (SELECT quantile_cont(event_id::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM j), b AS (SELECT ok, len(list_filter(e, lambda x: event_id > x)) AS bin FROM j, q)
   SELECT bin::INT AS bin, count(*) AS n, {R('avg(ok::INT)', 6)} AS accuracy, max(avg(ok::INT)) OVER () - min(avg(ok::INT)) OVER () > 0.12 AS flagged FROM b GROUP BY bin""")
def _(t):
    return r6(G.quartile_accuracy(_judged(t), "event_id"), "accuracy")


@query("a15_error_totals", "preds_split", f"""WITH {JUDGED} SELECT count(*) FILTER (label = 1 AND NOT ok) AS false_negatives, count(*) FILTER (label = 0 AND NOT ok) AS false_positives, {R('avg(ok::INT)', 6)} AS accuracy,
   {R('avg(ok::INT) FILTER (NOT abstain) - avg(ok::INT)', 6)} AS lift FROM j""")
def _(t):
    return r6(G.error_totals(_judged(t)).select("false_negatives", "false_positives", "accuracy", "lift"), "accuracy", "lift")


@query("t2_worst_mistakes", "preds_split", f"""WITH {JUDGED} SELECT video_id, label, {R('video_score', 4)} AS prob FROM j WHERE NOT ok ORDER BY abs(video_score - 0.3::DOUBLE) DESC, video_id LIMIT 20""")
def _(t):
    return G.worst_mistakes(_judged(t), 20, "video_score").select("video_id", "label", "prob")


@query("t7_severity_order", "preds_split", f"""WITH {JUDGED}, a AS (SELECT avg(ok::INT) AS o, avg(ok::INT) FILTER (NOT abstain) AS k FROM j),
   l AS (SELECT ok, unnest(['forgery_method', 'compression']) AS axis, unnest([forgery_method, compression]) AS value FROM j), s AS (SELECT axis, value, avg(ok::INT) AS acc FROM l GROUP BY 1, 2 HAVING count(*) >= 5)
   SELECT 'warn' AS severity, 'weak slice' AS title, axis || '=' || value AS subject, {R('acc', 4)} AS value FROM s, a WHERE o - acc > 0.1 QUALIFY acc = min(acc) OVER (PARTITION BY axis)
   UNION ALL SELECT 'info', 'missed fakes', 'all', count(*) FILTER (label = 1 AND NOT ok)::DOUBLE FROM j UNION ALL SELECT 'info', 'false accusations', 'all', count(*) FILTER (label = 0 AND NOT ok)::DOUBLE FROM j
   UNION ALL SELECT CASE WHEN k - o > 0.01 THEN 'info' ELSE 'warn' END, 'abstention lift', 'all', {R('k - o', 4)} FROM a""")
def _(t):
    p = t.preds_split.withColumn("abstain", F.col("video_score").between(0.25, 0.35))
    return G.failure_findings(p, 0.3, "video_score", ["forgery_method", "compression"])


_AXES = "forgery_method compression dataset has_audio".split()


@query("q8_failure_diagnosis", "preds_split", f"""WITH fv AS MATERIALIZED (SELECT 1 AS g, * FROM preds_split WHERE split = 'val'), {roc_sql('fv', 'g')}, th AS (SELECT {EER_THR} AS thr FROM t),
   j AS (SELECT *, (video_score >= thr)::INT = label AS ok, (video_score >= 0.25 AND video_score <= 0.35) AS abstain FROM fv, th),
   a AS (SELECT count(*) AS n, avg(ok::INT) AS o, avg(ok::INT) FILTER (NOT abstain) AS k, count(*) FILTER (NOT abstain) AS kept, avg(abstain::INT) AS held FROM j),
   l AS (SELECT ok, unnest({_AXES}) AS axis, unnest([{', '.join(f'{x}::VARCHAR' for x in _AXES)}]) AS value FROM j), s AS (SELECT axis, value, avg(ok::INT) AS acc FROM l GROUP BY 1, 2 HAVING count(*) >= 5),
   e AS (SELECT quantile_cont(event_id::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM j), b AS (SELECT len(list_filter(e, lambda x: event_id > x)) AS bin, avg(ok::INT) AS acc FROM j, e GROUP BY 1 HAVING count(*) >= 5)
   SELECT 'warn' AS severity, 'weak slice' AS title, axis || '=' || value AS subject, {R('acc', 4)} AS value FROM s, a WHERE o - acc > 0.1 QUALIFY acc = min(acc) OVER (PARTITION BY axis)
   UNION ALL SELECT 'info', 'missed fakes', 'all', count(*) FILTER (label = 1 AND NOT ok)::DOUBLE FROM j UNION ALL SELECT 'info', 'false accusations', 'all', count(*) FILTER (label = 0 AND NOT ok)::DOUBLE FROM j
   UNION ALL SELECT CASE WHEN k - o > 0.01 THEN 'info' ELSE 'warn' END, 'abstention lift', 'all', {R('k - o', 4)} FROM a WHERE held > 0
   UNION ALL SELECT 'warn', 'accuracy varies', 'event_id', {R('max(acc) - min(acc)', 4)} FROM b HAVING count(*) >= 2 AND max(acc) - min(acc) > 0.12""")
def _(t):
    from ..operators import roc

    val = media.readable(t.preds_split, "a4_failure").where("split = 'val'").withColumn("abstain", F.col("video_score").between(0.25, 0.35))
    thr = roc.threshold_value(val, "label", "video_score")
    return G.failure_findings(val, thr, "video_score", ["forgery_method", "compression", "dataset", "has_audio"], ["event_id"])


@query("j1_manifest_metadata", "preds manifest", """SELECT count(*) AS n, count(m.video_id) AS matched, round(sum(m.duration_s), 2) AS total FROM (SELECT 'o' || event_id AS video_id FROM preds) p LEFT JOIN manifest m USING (video_id)""")
def _(t):
    p = t.preds.select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("video_id"))
    out = G.with_metadata(p, t.manifest)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("fps").alias("matched"), F.round(F.sum("duration_s"), 2).alias("total"))


@query("j17_score_parity", "preds_alt", f"""WITH a AS (SELECT video_id, video_score AS s FROM preds_alt WHERE event_id % 10 <> 3), b AS (SELECT video_id, alt_score AS s FROM preds_alt WHERE event_id % 10 <> 4)
   SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS n_both, count(*) FILTER (b.s IS NULL) AS only_a, count(*) FILTER (a.s IS NULL) AS only_b, {R('max(abs(a.s - b.s))', 6)} AS max_gap, false AS ok FROM a FULL JOIN b USING (video_id)""")
def _(t):
    a = t.preds_alt.where("event_id % 10 <> 3").select("video_id", F.col("video_score").alias("score"))
    b = t.preds_alt.where("event_id % 10 <> 4").select("video_id", F.col("alt_score").alias("score"))
    return r6(G.score_parity(a, b), "max_gap")


_BAL = f"""z AS (SELECT video_id, CASE WHEN label = 0 THEN 'real' ELSE 'fake:' || forgery_method END AS stratum, {H("'0:1:' || video_id")} AS u FROM manifest), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, video_id) AS r, count(*) OVER (PARTITION BY stratum) AS k,
   CASE WHEN stratum = 'real' THEN 6000 ELSE 6000 // (SELECT count(DISTINCT forgery_method) FROM manifest WHERE label = 1) END AS q FROM z)"""


@query("a23_balanced_sample", "manifest", f"WITH {_BAL} SELECT stratum, video_id, q // k + (CASE WHEN r <= q % k THEN 1 ELSE 0 END) AS n FROM r WHERE q // k + (CASE WHEN r <= q % k THEN 1 ELSE 0 END) > 0")
def _(t):
    return sampling.balanced_sample(t.manifest, 12000, 0, 1).groupBy("stratum", "video_id").agg(F.count(F.lit(1)).alias("n"))


@query("a24_stratified_batches", "manifest", f"""WITH z AS (SELECT video_id, has_audio, {H("'0:0:' || video_id")} AS u FROM manifest), s AS (SELECT *, row_number() OVER (PARTITION BY has_audio ORDER BY u, video_id) AS r, count(*) OVER (PARTITION BY has_audio) AS k, count(*) OVER () // 32 AS nb FROM z),
   d AS (SELECT has_audio, CASE WHEN has_audio THEN 8 ELSE 24 END AS sh, r, k, nb, unnest(range(0, ((nb * CASE WHEN has_audio THEN 8 ELSE 24 END - r) // k) + 1)) AS c FROM s WHERE r <= nb * CASE WHEN has_audio THEN 8 ELSE 24 END)
   SELECT (c * k + r - 1) // sh AS batch, count(*) FILTER (has_audio) AS n_audio, count(*) AS n FROM d GROUP BY 1""")
def _(t):
    b = sampling.stratified_batches(t.manifest, 32)
    return b.groupBy("batch").agg(F.count(F.when(F.col("has_audio"), 1)).alias("n_audio"), F.count(F.lit(1)).alias("n"))
