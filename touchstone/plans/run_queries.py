"""Queries over run trees, listings, claims and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts as V
from ..operators import diagnose as G
from ..operators import manifest as MF
from ..operators import metrics as M
from ..operators import monitor as N
from ..operators import roc
from ..operators import runs as RN
from ..session import new_path
from ..sources import files, logs, manifests as S
from ..sources import predictions as P
from ..sources import runs as RT
from .fixtures import R, SPLIT
from .metric_queries import AUC, CI_HI, CI_LO, CURVE, EER_THR, VAR, Z95, bin15, r6, roc_sql
from .registry import query
from .scoring_queries import CAL, SCORED, SIG
from .stream_queries import VAR as _VARIANT_SQL
from .text_queries import DIVERGED as _DIVERGED_SQL
from .text_queries import logged

# ---- run tables ------------------------------------------------------------------
_SEEDS = """ag AS (SELECT exp, split, count(DISTINCT seed) AS n_seeds, arg_min(n, seed) AS n, avg(auc) AS auc_mean, avg(accuracy) AS accuracy_mean, avg(f1) AS f1_mean, avg(eer) AS eer_mean, avg(ece) AS ece_mean,
   stddev_samp(auc) AS auc_std, stddev_samp(accuracy) AS accuracy_std, stddev_samp(f1) AS f1_std, stddev_samp(eer) AS eer_std, stddev_samp(ece) AS ece_std FROM runs GROUP BY 1, 2)"""
_STATS = [f"{m}_{k}" for k in ("mean", "std") for m in RN.SEED_METRICS]


@query("a7_seed_aggregation", "runs", f"WITH {_SEEDS} SELECT exp, split, n_seeds, n, {', '.join(f'{R(k, 6)} AS {k}' for k in _STATS)}, n_seeds < 2 AS single_seed FROM ag")
def _(t):
    return r6(RN.aggregate_seeds(t.runs), *_STATS)


_GAP = f"""{_SEEDS}, bs AS (SELECT min(split) AS s FROM runs), gp AS (SELECT a.exp, a.split AS test_set, {R('b.auc_mean', 4)} AS in_dataset_auc, {R('a.auc_mean', 4)} AS cross_dataset_auc, {R('b.auc_mean - a.auc_mean', 4)} AS gap, a.n_seeds
   FROM ag a JOIN ag b ON a.exp = b.exp AND b.split = (SELECT s FROM bs) WHERE a.split <> (SELECT s FROM bs))"""


@query("j10_cross_dataset_table", "runs", f"WITH {_GAP} SELECT * FROM gp")
def _(t):
    base = t.runs.agg(F.min("split").alias("s")).first()["s"]
    return RN.cross_table(RN.aggregate_seeds(t.runs), base)


@query("t6_gap_order", "runs", f"WITH {_GAP} SELECT row_number() OVER (ORDER BY gap DESC, exp, test_set) AS rank, exp, test_set FROM gp")
def _(t):
    from pyspark.sql import Window

    base = t.runs.agg(F.min("split").alias("s")).first()["s"]
    top = RN.cross_table(RN.aggregate_seeds(t.runs), base)
    w = Window.orderBy(F.desc("gap"), "exp", "test_set")
    return top.select(F.row_number().over(w).alias("rank"), "exp", "test_set")


@query("a8_method_matrix", "preds_split", f"""WITH {roc_sql('preds_split', 'dataset, split')}, a AS (SELECT dataset AS method, split, {AUC} AS auc FROM t GROUP BY 1, 2)
   SELECT method, {R("coalesce(max(auc) FILTER (split = 'test'), 0)", 6)} AS test, {R("coalesce(max(auc) FILTER (split = 'train'), 0)", 6)} AS train, {R("coalesce(max(auc) FILTER (split = 'val'), 0)", 6)} AS val FROM a GROUP BY method""")
def _(t):
    a = roc.auc(t.preds_split, "label", "video_score", ["dataset", "split"])
    names = a.select(F.concat(F.col("split"), F.lit("/forgery_method="), F.col("dataset")).alias("name"), "auc")
    return r6(RN.method_matrix(names, ["test", "train", "val"]), "test", "train", "val")


@query("a9_untrustworthy_runs", "runs", """SELECT exp, u.flag, count(*) AS n_rows FROM runs, LATERAL (SELECT unnest(list_filter([CASE WHEN seed = 1 THEN 'degenerate calibration' END, CASE WHEN exp = 'R' THEN 'dirty tree' END], lambda x: x IS NOT NULL)) AS flag) u GROUP BY 1, 2""")
def _(t):
    r = t.runs.withColumns({"calibration_degenerate": F.col("seed") == 1, "git_sha": F.when(F.col("exp") == "R", "abc-dirty").otherwise("abc")})
    return RN.untrustworthy(r)


_STATUS_SQL = """SELECT run, CASE WHEN bool_or(name = 'preds_val.csv') AND bool_or(name = 'summary.json') THEN 'done' WHEN bool_or(name = 'metrics.jsonl') THEN 'running' ELSE 'failed' END AS status FROM (
     SELECT DISTINCT job_id % 1000 AS run, CASE state WHEN 'done' THEN 'preds_val.csv' WHEN 'failed' THEN 'summary.json' WHEN 'running' THEN 'metrics.jsonl' ELSE 'x' END AS name FROM changes) GROUP BY run"""


def _run_files(t):
    name = F.when(F.col("state") == "done", "preds_val.csv").when(F.col("state") == "failed", "summary.json").when(F.col("state") == "running", "metrics.jsonl").otherwise("x")
    return t.changes.select((F.col("job_id") % 1000).alias("run"), name.alias("name"))


@query("a10_run_status", "changes", _STATUS_SQL)
def _(t):
    return RN.run_status(_run_files(t))


@query("a11_validation_trend", "epochs", """WITH b AS (SELECT run, count(*) AS epochs, max({'v': val_auc, 'e': -epoch}) AS best, max(epoch) AS last FROM epochs GROUP BY run)
   SELECT run, epochs, round(best.v, 4) AS best, -best.e AS best_epoch, last + best.e AS stalled_epochs, best.v > 0.995 AND -best.e <= 1 AND epochs > 1 AS suspiciously_high, last + best.e >= 4 AS stall_warning FROM b""")
def _(t):
    return RN.val_trend(t.epochs)


def write_tree(t) -> str:
    """A run tree on shared storage, written by Spark from the ``runs`` view."""
    root = new_path(t.spark, "runs")
    r = t.runs
    metrics = ["n", *RN.SEED_METRICS]
    body = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", F.struct(*metrics))))))
    reports = r.groupBy("exp", "seed").agg(body.alias("value"))
    stamp = F.to_json(F.struct(F.when(F.col("exp") == "R", "abc-dirty").otherwise("abc").alias("git_sha"), F.lit("h").alias("config_hash")))
    cal = F.to_json(F.struct((F.col("seed") == 1).alias("degenerate")))
    each = reports.select("exp", "seed").where("seed < 2")
    lines = t.epochs.withColumn("exp", F.concat(F.lit("e"), F.col("run").cast("string"))).withColumn("seed", F.col("run") % 3)
    tables = {
        "metrics_report.json": reports,
        "stamp.json": each.select("exp", "seed", stamp.alias("value")),
        "calibration.json": each.select("exp", "seed", cal.alias("value")),
        "metrics.jsonl": lines.select("exp", "seed", F.to_json(F.struct("epoch", "val_auc")).alias("value")),
    }
    place(t.spark, root, tables)
    return root


def place(spark, root: str, tables: dict) -> None:
    """Write text tables and move each part to ``<root>/<exp>/seed<k>/<name>``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    for name, df in tables.items():
        tmp = new_path(spark, "parts")
        df.repartition("exp", "seed").write.partitionBy("exp", "seed").text(tmp)
        for st in fs.globStatus(path(f"{tmp}/exp=*/seed=*/part-*")):
            src = st.getPath()
            seed, exp = src.getParent().getName(), src.getParent().getParent().getName()
            folder = f"{root}/{exp.split('=')[1]}/seed{seed.split('=')[1]}"
            fs.mkdirs(path(folder))
            fs.rename(src, path(f"{folder}/{name}"))


@query("s10_run_tree", "runs", f"""SELECT exp, seed, split, n, false AS is_breakdown, CASE WHEN seed = 2 THEN '?' WHEN exp = 'R' THEN 'abc-dirty' ELSE 'abc' END AS git_sha, CASE WHEN seed < 2 THEN seed = 1 END AS calibration_degenerate,
   {R('auc', 6)} AS auc, {R('ece', 6)} AS ece FROM runs""")
def _(t):
    runs = RT.collect_runs(t.spark, write_tree(t))
    return r6(runs.select("exp", "seed", "split", "n", "is_breakdown", "git_sha", "calibration_degenerate", "auc", "ece"), "auc", "ece")


@query("s12_epoch_lines", "epochs", "SELECT 'e' || run || '/seed' || (run % 3) AS run, epoch::INT AS epoch, val_auc FROM epochs")
def _(t):
    return RT.read_epochs(t.spark, write_tree(t))


@query("s15_result_tables", "runs", f"WITH {_SEEDS} SELECT exp, split, n_seeds, {R('auc_mean', 4)} AS auc_mean FROM ag")
def _(t):
    out = new_path(t.spark, "results")
    RT.write_results(RT.collect_runs(t.spark, write_tree(t)), out)
    df = t.spark.read.csv(f"{out}/by_experiment", header=True)
    from ..functions.numeric import half_up

    return df.select("exp", "split", F.col("n_seeds").cast("bigint").alias("n_seeds"), half_up(F.col("auc_mean").cast("double"), 4).alias("auc_mean"))


@query("q4_aggregate_runs", "runs", f"""WITH {_GAP}
   SELECT 'gap' AS part, exp || '/' || test_set AS subject, unnest(['in_dataset_auc', 'cross_dataset_auc', 'gap']) AS name, unnest([in_dataset_auc, cross_dataset_auc, gap])::DOUBLE AS value FROM gp
   UNION ALL SELECT 'flag', exp || '/' || u.flag, 'n_rows', count(*)::DOUBLE FROM runs, LATERAL (SELECT unnest(list_filter([CASE WHEN seed = 1 THEN 'degenerate calibration' END, CASE WHEN exp = 'R' AND seed < 2 THEN 'dirty tree' END], lambda x: x IS NOT NULL)) AS flag) u GROUP BY 1, 2
   UNION ALL SELECT 'table', exp || '/' || split, unnest(['n_seeds', 'auc_mean']), unnest([n_seeds::DOUBLE, {R('auc_mean', 4)}]) FROM ag""")
def _(t):
    from ..functions.numeric import half_up
    from .reports import long_form

    runs, out = RT.collect_runs(t.spark, write_tree(t)), new_path(t.spark, "results")
    RT.write_results(runs, out)
    table = t.spark.read.csv(f"{out}/by_experiment", header=True).withColumn("auc_mean", half_up(F.col("auc_mean").cast("double"), 4))
    base = t.runs.agg(F.min("split").alias("s")).first()["s"]
    gaps = RN.cross_table(RN.aggregate_seeds(runs), base)
    flags = RN.untrustworthy(runs)
    return (
        long_form(gaps, "gap", F.concat_ws("/", "exp", "test_set"), ["in_dataset_auc", "cross_dataset_auc", "gap"])
        .unionByName(long_form(flags, "flag", F.concat_ws("/", "exp", "flag"), ["n_rows"]))
        .unionByName(long_form(table, "table", F.concat_ws("/", "exp", "split"), ["n_seeds", "auc_mean"]))
    )


@query("q9_run_monitoring", "epochs changes", f"""WITH b AS (SELECT run, count(*) AS epochs, max({{'v': val_auc, 'e': -epoch}}) AS best, max(epoch) AS last FROM epochs GROUP BY run),
   l AS ({_STATUS_SQL}), dv AS ({_DIVERGED_SQL})
   SELECT 'blocker' AS severity, 'run failed' AS title, run::VARCHAR AS subject FROM l WHERE status = 'failed'
   UNION ALL SELECT 'warn', 'stalled', 'e' || run || '/seed' || (run % 3) FROM b WHERE last + best.e >= 4
   UNION ALL SELECT 'blocker', 'too good too early', 'e' || run || '/seed' || (run % 3) FROM b WHERE best.v > 0.995 AND -best.e <= 1 AND epochs > 1
   UNION ALL SELECT 'blocker', reason, run || ':' || source FROM dv""")
def _(t):
    from .reports import run_findings

    return run_findings(_run_files(t), RT.read_epochs(t.spark, write_tree(t)), logged(t))


# ---- predictions --------------------------------------------------------------------
def _preds_folder(t, runs=("m1/seed0", "m1/seed1", "m2/seed0")) -> str:
    root = new_path(t.spark, "tree")
    rows = t.preds_logit.select("video_id", "label", "dataset", "forgery_method", "has_audio", "logit", "split")
    spark = t.spark
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    for split in ("val", "test"):
        for run in runs:
            tmp = new_path(spark, "parts")
            P.write_preds(rows.where(F.col("split") == split), tmp, CAL)
            fs.mkdirs(path(f"{root}/{run}"))
            fs.rename(path(tmp), path(f"{root}/{run}/preds_{split}.csv"))
    return root


_PROBS = f"""SELECT video_id, {R(SIG('logit'), 6)} AS video_score, {R(SIG('logit / 1.7::DOUBLE'), 6)} AS calibrated_prob, {SIG('logit / 1.7::DOUBLE')} >= 0.35 AND {SIG('logit / 1.7::DOUBLE')} <= 0.45 AS abstain FROM preds_logit"""


@query("s3_predictions_scan", "preds_logit", f"{_PROBS} WHERE split = 'val'")
def _(t):
    root = _preds_folder(t, ["m1/seed0"])
    df = P.read_preds(t.spark, f"{root}/m1/seed0/preds_val.csv")
    return r6(df.select("video_id", "video_score", "calibrated_prob", "abstain"), "video_score", "calibrated_prob")


@query("s4_predictions_sink", "preds_logit", _PROBS)
def _(t):
    return r6(P.to_preds(t.preds_logit.drop("video_score"), CAL).select("video_id", "video_score", "calibrated_prob", "abstain"), "video_score", "calibrated_prob")


@query("s4_json_columns", "frames", f"""SELECT clip::VARCHAR AS video_id, count(*) AS n, sum(floor(score * 100000.0::DOUBLE + 0.5::DOUBLE)::BIGINT)::BIGINT AS total FROM frames GROUP BY clip""")
def _(t):
    arr = t.frames.groupBy(F.col("clip").cast("string").alias("video_id")).agg(F.collect_list("score").alias("frame_scores"))
    rows = arr.withColumns({"label": F.lit(0), "dataset": F.lit("custom"), "forgery_method": F.lit("real"), "has_audio": F.lit(True), "logit": F.lit(0.1)})
    out = P.parsed(P.to_preds(rows))
    total = F.aggregate("frame_scores", F.lit(0).cast("bigint"), lambda s, x: s + F.floor(x * 100000.0 + 0.5))
    return out.select("video_id", F.size("frame_scores").cast("bigint").alias("n"), total.alias("total"))


@query("s11_prediction_discovery", "preds_logit", "SELECT DISTINCT m || '/' || split AS key, 'seed0' AS seed FROM preds_logit, (SELECT unnest(['m1', 'm2']) AS m) WHERE split IN ('val', 'test')")
def _(t):
    found = RT.discover_preds(t.spark, _preds_folder(t))
    return found.select("key", F.regexp_extract("path", r"(seed\d+)", 1).alias("seed"))


@query("s16_report_sink", "preds_split", f"""WITH {roc_sql('preds_split', 'split')} SELECT split AS name, (max(p) + max(n))::BIGINT AS n, {R(AUC, 6)} AS auc FROM t GROUP BY split""")
def _(t):
    path = new_path(t.spark, "reports")
    RT.write_reports(M.evaluate(t.preds_split.withColumn("name", F.col("split")), 0.3, "fixed", ["name"]), path)
    return r6(t.spark.read.schema("name string, n bigint, auc double").json(f"{path}/json"), "auc")


# ---- files and logs ---------------------------------------------------------------------
def _listing(t) -> str:
    """Small placeholder files named like clips, some not video at all."""
    root = new_path(t.spark, "media")
    rows = t.spark.read.parquet(f"{t.dir}/supplier.parquet").select(
        F.when(F.col("s_suppkey") % 3 == 0, "MP4").when(F.col("s_suppkey") % 3 == 1, "avi").otherwise("txt").alias("seed"),
        (F.col("s_suppkey") % 7).cast("string").alias("exp"), F.col("s_name").alias("value"),
    )
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    tmp = new_path(t.spark, "parts")
    rows.repartition("exp", "seed").write.partitionBy("exp", "seed").text(tmp)
    for st in fs.globStatus(path(f"{tmp}/exp=*/seed=*/part-*")):
        src = st.getPath()
        ext, folder = src.getParent().getName().split("=")[1], src.getParent().getParent().getName().split("=")[1]
        fs.mkdirs(path(f"{root}/d{folder}"))
        fs.rename(src, path(f"{root}/d{folder}/clip.{ext}"))
    return root


@query("s5_video_listing", "", """SELECT DISTINCT 'd' || (s_suppkey % 7) || '/clip.' || CASE s_suppkey % 3 WHEN 0 THEN 'MP4' ELSE 'avi' END AS file FROM supplier WHERE s_suppkey % 3 < 2""")
def _(t):
    return files.list_files(t.spark, _listing(t)).select(F.regexp_extract("path", r"(d\d+/[^/]+)$", 1).alias("file"))


@query("u4_distinct_files", "", """SELECT count(DISTINCT (s_suppkey % 7) || '-' || (s_suppkey % 3)) AS n FROM supplier WHERE s_suppkey % 3 < 2""")
def _(t):
    root = _listing(t)
    return files.collect_videos(t.spark, [root, root], recursive=True).agg(F.count(F.lit(1)).alias("n"))


@query("s13_claims_scan", "runs", "SELECT exp || split AS claim_id, round(avg(auc), 4)::VARCHAR AS expected_value FROM runs GROUP BY exp, split")
def _(t):
    path = new_path(t.spark, "claims")
    c = t.runs.groupBy("exp", "split").agg(F.round(F.avg("auc"), 4).alias("v"))
    rows = c.select(F.concat_ws(",", F.lit("s"), F.concat("exp", "split"), F.lit("f"), F.lit("r.csv"), F.lit("auc"), F.lit("exp=x"), F.col("v").cast("string"), F.lit("ok")).alias("value"))
    head = F.lit("# note, with, commas\n\nsection,claim_id,sentence_fragment,results_file,column,row_selector,expected_value,status\n")
    # A header belongs to every part file, as Spark's own CSV writer does it.
    rows.groupBy((F.hash("value") % 4).alias("k")).agg(F.concat(head, F.array_join(F.collect_list("value"), "\n")).alias("value")).write.partitionBy("k").text(path)
    return logs.read_claims(t.spark, path).select("claim_id", "expected_value")


@query("s14_verdict_sink", "preds_logit", f"""SELECT count(*) AS n, {R('sum(' + R(SIG('logit / 1.7::DOUBLE'), 4) + ')', 2)} AS total FROM preds_logit""")
def _(t):
    path = new_path(t.spark, "verdicts")
    v = V.score_logits(t.preds_logit, CAL).select("video_id", "verdict", (F.floor(F.col("calibrated_prob") * 10000 + 0.5) / 10000.0).alias("p"))
    logs.write_verdicts(v, f"{path}/a", "csv")
    logs.write_verdicts(v, f"{path}/b", "jsonl")
    back = t.spark.read.schema("video_id string, verdict string, p double").json(f"{path}/b")
    same = t.spark.read.schema("video_id string, verdict string, p double").csv(f"{path}/a", header=True)
    return back.join(same, ["video_id", "verdict", "p"]).agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum("p") * 100 + 0.5) / 100.0).alias("total"))


@query("s17_audit_log", "", """SELECT substr(sha256(text), 1, 16) AS inputs_hash, substr(sha256(lang || source), 1, 16) AS output_hash, substr(lang || source, 1, 280) AS output_preview FROM documents""")
def _(t):
    path = new_path(t.spark, "audit")
    d = t.documents.select("text", F.concat("lang", "source").alias("said"))
    recs = logs.audit_record(d, F.lit("a4"), F.lit("read"), "text", "said")
    logs.append_audit(recs, path)
    return logs.read_audit(t.spark, path).select("inputs_hash", "output_hash", "output_preview")


@query("s19_failure_tables", "variants", "SELECT video_id || '/' || variant AS path, error FROM variants WHERE error <> ''")
def _(t):
    path = new_path(t.spark, "failures")
    good, bad = files.split_failures(t.variants.withColumn("path", F.concat_ws("/", "video_id", "variant")))
    files.write_failures(bad, path)
    return t.spark.read.schema("path string, error string").csv(path, sep="\t")


# ---- dataset layouts -----------------------------------------------------------------------
def _paths(t, body):
    return t.raw("orders").select(body.alias("path"))


def key():
    return F.col("o_orderkey")


def _text_file(t, df, name):
    path = new_path(t.spark, name)
    df.write.text(path)
    return path


@query("j7_official_split", "", """WITH s AS (SELECT id, CASE WHEN id < 300 THEN 'train' WHEN id < 400 THEN 'val' ELSE 'test' END AS split FROM (SELECT unnest(range(0, 500)) AS id)),
   f AS (SELECT o_orderkey AS k, o_orderkey % 600 AS a, o_custkey % 600 AS b FROM orders)
   SELECT k, coalesce(x.split, y.split) AS split FROM f LEFT JOIN s x ON x.id = a LEFT JOIN s y ON y.id = b WHERE (x.split IS NOT NULL OR y.split IS NOT NULL) AND coalesce(x.split = y.split, true)""")
def _(t):
    ids = t.raw("orders").select((key() % 600).alias("id")).distinct().where("id < 500")
    split = F.when(F.col("id") < 300, "train").when(F.col("id") < 400, "val").otherwise("test")
    splits = ids.select(F.col("id").cast("string").alias("id"), split.alias("split"))
    rows = t.raw("orders").select(key().alias("k"), F.array((key() % 600).cast("string"), (F.col("o_custkey") % 600).cast("string")).alias("ids"))
    return S.official_split(rows, splits, "ids", "k").select("k", "split")


@query("s8_official_splits", "", """SELECT DISTINCT (o_orderkey % 500)::VARCHAR AS id, CASE WHEN o_orderkey % 500 < 300 THEN 'train' WHEN o_orderkey % 500 < 400 THEN 'val' ELSE 'test' END AS split FROM orders""")
def _(t):
    root = new_path(t.spark, "splits")
    ids = t.raw("orders").select((key() % 500).alias("i")).distinct()
    split = F.when(F.col("i") < 300, "train").when(F.col("i") < 400, "val").otherwise("test")
    pairs = ids.groupBy(split.alias("split")).agg(F.to_json(F.collect_list(F.array(F.col("i").cast("string"), F.col("i").cast("string")))).alias("value"))
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    tmp = new_path(t.spark, "parts")
    pairs.repartition("split").write.partitionBy("split").text(tmp)
    fs.mkdirs(path(root))
    for st in fs.globStatus(path(f"{tmp}/split=*/part-*")):
        fs.rename(st.getPath(), path(f"{root}/{st.getPath().getParent().getName().split('=')[1]}.json"))
    return S.read_official_splits(t.spark, root)


@query("s9_test_list", "", "SELECT DISTINCT 'id' || (o_custkey % 60) || '_' || (o_orderkey % 10) || '.mp4' AS name FROM orders")
def _(t):
    name = F.concat(F.lit("1 Celeb-real/id"), (F.col("o_custkey") % 60).cast("string"), F.lit("_"), (key() % 10).cast("string"), F.lit(".mp4"))
    lines = t.raw("orders").select(F.when(key() % 2 == 0, name).otherwise(F.concat(name, F.lit("  "))).alias("value"))
    return S.read_test_list(t.spark, _text_file(t, lines.unionByName(lines.select(F.lit("").alias("value")).limit(1)), "list"))


_CELEB = """r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS g, 'id' || (o_custkey % 60) AS a, 'id' || (o_custkey % 7) AS b, o_orderkey::VARCHAR AS tail FROM orders),
  f AS (SELECT k, g, CASE g WHEN 0 THEN a || '_' || tail WHEN 1 THEN tail ELSE a || '_' || b || '_' || tail END AS stem, CASE g WHEN 0 THEN 'celebdf_' || a WHEN 1 THEN 'celebdf_yt_' || tail ELSE 'celebdf_' || CASE WHEN a < b THEN a || '+' || b WHEN a > b THEN b || '+' || a ELSE a END END AS who FROM r)"""


@query("j8_test_list_split", "", f"""WITH {_CELEB}, u AS (SELECT *, ('0x' || substr(sha256('0:' || who), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f)
   SELECT k, who AS source_identity, CASE WHEN k % 5 = 0 THEN 'test' WHEN u < 0.8::DOUBLE THEN 'train' ELSE 'val' END AS split FROM u""")
def _(t):
    k = key().cast("string")
    a, b = (F.concat(F.lit("id"), (F.col("o_custkey") % n).cast("string")) for n in (60, 7))
    path = F.when(key() % 3 == 0, F.concat(F.lit("/c/Celeb-real/"), a, F.lit("_"), k)).when(key() % 3 == 1, F.concat(F.lit("/c/YouTube-real/"), k)).otherwise(F.concat(F.lit("/c/Celeb-synthesis/"), F.concat_ws("_", a, b, k)))
    listing = _paths(t, F.concat(path, F.lit(".mp4")))
    last = F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("bigint")
    test = listing.where(last % 5 == 0).select(S.basename("path").alias("name"))
    m = S.parse_dataset("celebdf", listing, test)
    return m.select(F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("bigint").alias("k"), "source_identity", "split")


#: Records of a metadata file that a query makes.
PER_FILE = 1000


def _folded(t, container, *by):
    """Metadata files of about PER_FILE records, as many as the table and the groups of ``by`` ask for."""
    orders = t.raw("orders")
    groups = max(1, orders.select(*by).distinct().count()) if by else 1
    files = max(1, -(-orders.count() // (PER_FILE * groups)))
    cells = orders.groupBy(*by, F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).alias("_file")).agg(container.alias("value"))
    return cells.drop("_file")


@query("s6_dfdc_metadata", "", """SELECT 'dfdc_part_' || (o_orderkey % 4) || '_' || o_orderkey AS video_id, (o_orderkey % 2)::INT AS label, CASE WHEN o_orderkey % 2 = 1 THEN 'dfdc_' || (o_orderkey - 1) ELSE 'dfdc_' || o_orderkey END AS source_identity,
   CASE o_orderkey % 4 WHEN 3 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM orders""")
def _(t):
    file = F.concat(key().cast("string"), F.lit(".mp4"))
    info = F.when(key() % 2 == 1, F.struct(F.lit("FAKE").alias("label"), F.concat((key() - 1).cast("string"), F.lit(".mp4")).alias("original"))).otherwise(F.struct(F.lit("REAL").alias("label"), F.lit(None).cast("string").alias("original")))
    part = F.concat(F.lit("part_"), (key() % 4).cast("string"))
    root = new_path(t.spark, "dfdc")
    bodies = _folded(t, F.to_json(F.map_from_entries(F.collect_list(F.struct(file, info)))), part.alias("part"))
    bodies.write.partitionBy("part").option("maxRecordsPerFile", 1).text(root)
    meta = S.read_dfdc_metadata(t.spark, f"{root}/*/part-*")
    listing = _paths(t, F.concat_ws("/", F.lit("/dfdc"), part, file))
    return S.parse_dataset("dfdc", listing, meta).select("video_id", "label", "source_identity", "split")


def _lavdf(t):
    rec = F.struct(
        F.concat(F.lit("test/"), key().cast("string"), F.lit(".mp4")).alias("file"),
        F.when(key() % 3 == 0, F.lit("spk1")).alias("original"),
        (key() % 4 == 1).alias("modify_video"),
        (key() % 4 >= 2).alias("modify_audio"),
        F.when(key() % 4 == 3, F.array(F.array(F.lit(1.0), F.lit(2.5)), F.array(F.lit(4.0), key() % 10 + 4.5))).alias("fake_periods"),
    )
    root = new_path(t.spark, "lavdf")
    _folded(t, F.to_json(F.collect_list(rec))).write.option("maxRecordsPerFile", 1).text(root)
    meta = S.read_lavdf_metadata(t.spark, f"{root}/part-*")
    return S.parse_dataset("lavdf", _paths(t, F.concat(F.lit("/lav/test/"), key().cast("string"), F.lit(".mp4"))), meta)


@query("s7_lavdf_metadata", "", """SELECT 'lavdf_' || o_orderkey AS video_id, (o_orderkey % 4 <> 0)::INT AS label, CASE o_orderkey % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'lavdf_video' ELSE 'lavdf_audio' END AS forgery_method,
   'lavdf_' || CASE WHEN o_orderkey % 3 = 0 THEN 'spk1' ELSE o_orderkey::VARCHAR END AS source_identity, 'test' AS split FROM orders""")
def _(t):
    m, _ = _lavdf(t)
    return m.select("video_id", "label", "forgery_method", "source_identity", "split")


@query("s7_lavdf_intervals", "", """SELECT 'lavdf_' || o_orderkey AS video_id, 1.0::DOUBLE AS start_s, 2.5::DOUBLE AS end_s FROM orders WHERE o_orderkey % 4 = 3
   UNION ALL SELECT 'lavdf_' || o_orderkey, 4.0::DOUBLE, o_orderkey % 10 + 4.5::DOUBLE FROM orders WHERE o_orderkey % 4 = 3""")
def _(t):
    _, spans = _lavdf(t)
    return spans


@query("x3_parser_registry", "", f"""WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'ffpp_' || (o_orderkey % 900) ELSE 'ffpp_' || CASE WHEN (o_orderkey % 900)::VARCHAR < (o_custkey % 900)::VARCHAR THEN (o_orderkey % 900) || '+' || (o_custkey % 900) ELSE (o_custkey % 900) || '+' || (o_orderkey % 900) END END AS who FROM orders)
   SELECT DISTINCT who AS source_identity, {SPLIT("replace(substr(who, 6), '+', '_')")} AS split FROM p""")
def _(t):
    a, b = (key() % 900).cast("string"), (F.col("o_custkey") % 900).cast("string")
    path = F.when(key() % 2 == 0, F.concat(F.lit("/f/original_sequences/youtube/c23/videos/"), a)).otherwise(F.concat(F.lit("/f/manipulated_sequences/FaceSwap/c23/videos/"), a, F.lit("_"), b))
    m = S.parse_dataset("ffpp", _paths(t, F.concat(path, F.lit(".mp4"))), None)
    return m.select("source_identity", "split").distinct()


@query("f1_layout_identities", "", """SELECT DISTINCT 'fav_id' || (o_custkey % 50) AS source_identity, CASE o_orderkey % 4 WHEN 0 THEN 'real' WHEN 1 THEN 'fav_fake_video' WHEN 2 THEN 'fav_fake_audio' ELSE 'fav_fake_both' END AS forgery_method, (o_orderkey % 4 > 0)::INT AS label FROM orders""")
def _(t):
    combo = F.when(key() % 4 == 0, "RealVideo-RealAudio").when(key() % 4 == 1, "FakeVideo-RealAudio").when(key() % 4 == 2, "RealVideo-FakeAudio").otherwise("FakeVideo-FakeAudio")
    path = F.concat(F.lit("/fav/"), combo, F.lit("/African/men/id"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), key().cast("string"), F.lit(".mp4"))
    return S.parse_dataset("fakeavceleb", _paths(t, path)).select("source_identity", "forgery_method", "label").distinct()


# ---- claims --------------------------------------------------------------------------------
def _claims(t):
    exact = t.runs.select(
        F.concat_ws("-", "exp", F.col("seed").cast("string"), "split").alias("claim_id"),
        F.when(F.col("seed") == 2, "").otherwise("results/runs.csv").alias("results_file"),
        F.lit("auc").alias("column"),
        F.concat(F.lit("exp="), F.col("exp"), F.lit("; seed="), F.col("seed").cast("string"), F.lit(";split="), F.col("split"), F.lit(";nope=1")).alias("row_selector"),
        F.when((F.col("split") == "1995"), (F.col("auc") + 0.01).cast("string")).otherwise(F.col("auc").cast("string")).alias("expected_value"),
    )
    return exact


def _cells(t):
    return G.cells(t.runs.select("exp", "seed", "split", "auc"), "results/runs.csv", ["exp", "seed", "split"])


@query("j12_resolve_cells", "runs", f"SELECT exp || '-' || seed || '-' || split AS claim_id, CASE WHEN seed <> 2 THEN {R('auc', 6)} END AS actual FROM runs")
def _(t):
    from ..functions.numeric import half_up

    out = G.resolve_cells(_claims(t), _cells(t))
    return out.select("claim_id", half_up(F.col("actual").cast("double"), 6).alias("actual"))


@query("a16_claim_verdicts", "runs", "SELECT exp || '-' || seed || '-' || split AS claim_id, CASE WHEN seed = 2 THEN 'unbacked' WHEN split = '1995' THEN 'mismatched' ELSE 'verified' END AS verdict FROM runs")
def _(t):
    return G.claim_verdicts(_claims(t), _cells(t)).select("claim_id", "verdict")


@query("q10_reconciliation", "runs", r"""WITH v AS (SELECT CASE WHEN seed = 2 THEN 'u' WHEN split = '1995' THEN 'm' ELSE 'v' END AS k FROM runs),
   oc AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g'), '(?i)\b(solves?|solved|robust to all|state[- ]of[- ]the[- ]art|significantly outperforms|proves?|guarantees?|eliminates?|fully generaliz|completely|the|le|der)\b')) AS n FROM documents)
   SELECT severity, title, 'all' AS subject, n FROM (SELECT 'blocker' AS severity, 'claims disagree with results' AS title, count(*) FILTER (k = 'm') AS n FROM v UNION ALL SELECT 'blocker', 'claims without a number', count(*) FILTER (k = 'u') FROM v UNION ALL SELECT 'info', 'claims verified', count(*) FILTER (k = 'v') FROM v) WHERE n > 0
   UNION ALL SELECT 'warn', 'over-claims', doc_id::VARCHAR, n FROM oc WHERE n > 0
   UNION ALL SELECT 'blocker', 'banned token', token, count(DISTINCT doc_id) FROM documents, (SELECT unnest(['bark', 'rvc', 'tts', 'license', 'copyright', 'email', 'diffusers']) AS token) WHERE contains(lower(text), token) GROUP BY token""")
def _(t):
    from ..functions.text import OVERCLAIM
    from .reports import paper_findings

    # Three frequent words join the list so that the scan has hits on invented prose.
    pattern = OVERCLAIM.replace("completely", "completely|the|le|der")
    banned = ["bark", "rvc", "TTS", "license", "copyright", "email", "diffusers"]
    return paper_findings(_claims(t), _cells(t), t.documents.select("doc_id", "text"), banned, pattern)


# ---- whole jobs ------------------------------------------------------------------------------
@query("q1_build_manifest", "", f"""WITH {_CELEB}, u AS (SELECT *, ('0x' || substr(sha256('0:' || who), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM f),
   s AS (SELECT CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS split, g, k, who, k % 4 <> 0 AS au FROM u WHERE k % 40 <> 7),
   a AS (SELECT count(*) AS n, count(*) FILTER (au) AS w, count(*) FILTER (g = 2) AS fakes, count(*) FILTER (k % 50 = 3) AS gone FROM s)
   SELECT 'total' AS part, 'all' AS subject, unnest(['videos', 'datasets']) AS name, unnest([n, 1])::DOUBLE AS value FROM a
   UNION ALL SELECT 'split', 'celebdf/' || split, unnest(['n', 'n_real', 'n_fake', 'n_audio', 'n_identities']), unnest([count(*), count(*) FILTER (g < 2), count(*) FILTER (g = 2), count(*) FILTER (au), count(DISTINCT who)])::DOUBLE FROM s GROUP BY split
   UNION ALL SELECT 'method', 'celebdf_synthesis', 'n', fakes::DOUBLE FROM a
   UNION ALL SELECT 'audio', 'celebdf', unnest(['n', 'with_audio', 'pct']), unnest([n::DOUBLE, w::DOUBLE, {R('100.0::DOUBLE * w / n', 1)}]) FROM a
   UNION ALL SELECT 'leak', 'all', unnest(['identity_overlaps', 'label_conflicts', 'split_duplicates', 'cross_dataset_duplicates', 'missing_files', 'ok']), unnest([0, 0, 0, 0, gone, (gone = 0)::BIGINT])::DOUBLE FROM a""")
def _(t):
    k = key().cast("string")
    a, b = (F.concat(F.lit("id"), (F.col("o_custkey") % n).cast("string")) for n in (60, 7))
    path = F.when(key() % 3 == 0, F.concat(F.lit("/c/Celeb-real/"), a, F.lit("_"), k)).when(key() % 3 == 1, F.concat(F.lit("/c/YouTube-real/"), k)).otherwise(F.concat(F.lit("/c/Celeb-synthesis/"), F.concat_ws("_", a, b, k)))
    listing = _paths(t, F.concat(path, F.lit(".mp4")))
    n = F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("bigint")
    probes = listing.select("path", F.lit(25.0).alias("fps"), F.lit(100).alias("n_frames"), F.lit(4.0).alias("duration_s"), (n % 4 != 0).alias("has_audio"),
                            F.sha2("path", 256).alias("sha256"), F.when(n % 40 == 7, "ProbeError: no video stream").alias("error"))
    good, _ = S.join_probes(S.parse_dataset("celebdf", listing), probes)
    out = new_path(t.spark, "manifest")
    S.write_manifest(good, out)
    from .reports import manifest_audit

    on_disk = listing.where(n % 50 != 3).select("path")
    return r6(manifest_audit(S.read_manifest(t.spark, out), listing=on_disk), "value")


@query("q2_cache_and_duplicates", "manifest hashes doc_manifest", """WITH td AS (SELECT count(*) AS todo FROM manifest WHERE NOT (duration_s < 30 AND duration_s > 1)), h AS (SELECT * FROM hashes WHERE len(phash) > 0),
   pr AS (SELECT a.video_id AS va, b.video_id AS vb, len(list_filter(list_transform(range(1, least(len(a.phash), len(b.phash)) + 1), lambda i: bit_count(xor(a.phash[i], b.phash[i]))), lambda d: d <= 6)) AS k FROM h a JOIN h b ON a.video_id < b.video_id),
   c AS (SELECT a.dataset = b.dataset AS same, a.split = b.split AS sp FROM pr JOIN doc_manifest a ON a.video_id = va JOIN doc_manifest b ON b.video_id = vb WHERE k >= 3)
   SELECT todo, (SELECT count(*) FROM c WHERE same AND NOT sp) AS split_duplicates, (SELECT count(*) FROM c WHERE NOT same) AS cross_dataset_duplicates FROM td""")
def _(t):
    from ..operators import duplicates as D
    from .manifest_queries import _cache

    todo = MF.cache_todo(t.manifest, _cache(t), 1).agg(F.count(F.lit(1)).alias("todo"))
    rep = MF.leak_report(t.manifest, D.classify(t.hashes, t.doc_manifest))
    return todo.crossJoin(rep.select("split_duplicates", "cross_dataset_duplicates"))


@query("q5_batch_score", "preds_logit variants", f"""WITH {SCORED}, {_VARIANT_SQL}
   SELECT video_id, CASE WHEN bad THEN 'error' ELSE verdict END AS verdict, CASE WHEN NOT bad THEN {R('p', 4)} END AS calibrated_prob, 0.35::DOUBLE AS conformal_lo, 0.45::DOUBLE AS conformal_hi, 0.4::DOUBLE AS threshold,
     CASE WHEN NOT bad THEN ood END AS ood_flag, true AS calibration_reliable, has_audio, 1 AS n_faces_found, (NOT bad AND p >= 0.4)::INT AS n_suspicious_segments, CASE WHEN bad THEN 0 ELSE {R('p', 6)} END AS peak_frame_score,
     (NOT bad AND ood)::INT AS n_warnings, 'm1' AS model_version, CASE WHEN bad THEN 'ValueError: cannot decode' ELSE '' END AS error, n_scored, n_failed,
     {R('CASE WHEN n_scored > 0 THEN same / n_scored ELSE 0 END', 4)} AS verdict_agreement, {R('greatest(op, coalesce(hi, op)) - least(op, coalesce(lo, op))', 4)} AS prob_spread,
     n_scored > 0 AND same = n_scored AND greatest(op, hi) - least(op, lo) <= 0.15 AS stable
   FROM (SELECT *, event_id % 97 = 0 AS bad FROM rs) LEFT JOIN st USING (video_id)""")
def _(t):
    from ..operators.scoring import batch_verdicts
    from .stream_queries import _variants

    def predict(pdf):
        if (pdf["event_id"] % 97 == 0).any():
            raise ValueError("cannot decode")
        return {"logit": pdf["z"].to_numpy()}

    clips = t.preds_logit.select("video_id", "event_id", "has_audio", F.col("logit").alias("z"))
    scored = batch_verdicts(clips, predict, CAL, ["video_id", "has_audio"])
    p = F.col("calibrated_prob")
    results = scored.withColumns(
        {
            "conformal_lo": F.lit(CAL.conformal_lo), "conformal_hi": F.lit(CAL.conformal_hi), "threshold": F.lit(CAL.threshold), "calibration_degenerate": F.lit(False),
            "n_faces_found": F.lit(1), "frame_scores": F.when(p.isNotNull(), F.array(p, p / 2)), "frame_timestamps": F.array(F.lit(0.0), F.lit(1.0)),
            "warnings": F.when(F.col("ood_flag"), F.array(F.lit("novel input"))), "model_version": F.lit("m1"),
        }
    )
    stable = N.stability(_variants(t)).drop("original_verdict")
    rows = V.summary(results).join(results.select("video_id", "error"), "video_id").join(stable, "video_id", "left")
    out = new_path(t.spark, "verdicts")
    logs.write_verdicts(r6(rows, "peak_frame_score"), out, "jsonl")
    return t.spark.read.schema(rows.schema).json(out)


_FIG_CURVE = CURVE.replace("dataset", "split").replace("FROM preds)", "FROM fp)").replace("0.3::DOUBLE", "(SELECT thr FROM th)")


@query("q6_figure_data", "preds_logit", f"""WITH fp AS MATERIALIZED (SELECT video_id, label, dataset, split, {R(SIG('logit'), 6)} AS video_score FROM preds_logit WHERE split IN ('val', 'test')),
   fv AS (SELECT 1 AS g, * FROM fp WHERE split = 'val'), {roc_sql('fv', 'g', pre='v')}, th AS (SELECT {EER_THR} AS thr FROM vt),
   {roc_sql('fp', 'split')}, {roc_sql('fp', 'split, dataset', pre='m')},
   d AS (SELECT split, {AUC} AS a, {VAR} AS v FROM t GROUP BY split),
   e AS (SELECT *, ln(a / (1.0::DOUBLE - a + 1e-12) + 1e-12) AS c, sqrt(v) / (a * (1.0::DOUBLE - a) + 1e-12) * {Z95}::DOUBLE AS h FROM d),
   b AS (SELECT split, {bin15('video_score', 10)} AS bin, count(*) AS k, avg(label::DOUBLE) AS y, avg(video_score) AS s FROM fp GROUP BY 1, 2), {_FIG_CURVE},
   f AS (SELECT 'roc' AS figure, split AS series, score AS label, fpr AS x, tpr AS y FROM t WHERE corner
     UNION ALL SELECT DISTINCT 'roc', split, 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t
     UNION ALL SELECT 'auc', split, NULL, unnest([0.0::DOUBLE, 1, 2]), unnest([a, {CI_LO}, {CI_HI}]) FROM e
     UNION ALL SELECT 'reliability', split, k, (bin * 0.1::DOUBLE + (bin + 1) * 0.1::DOUBLE) / 2, y FROM b WHERE bin IS NOT NULL
     UNION ALL SELECT 'ece', split, NULL, NULL, sum(k * abs(y - s)) / sum(k) FROM b GROUP BY split
     UNION ALL SELECT 'risk', split, rank, coverage, risk FROM rc
     UNION ALL SELECT 'methods', split || '/' || dataset, NULL, NULL, {AUC} FROM mt GROUP BY split, dataset
     UNION ALL SELECT 'gap', 'test', NULL, NULL, max(a) FILTER (split = 'val') - max(a) FILTER (split = 'test') FROM d)
   SELECT figure, series, label, {R('x', 6)} AS x, {R('y', 6)} AS y FROM f""")
def _(t):
    from .reports import figure_data

    # The files of one run are found in its tree and read by contract; splits are their names.
    found = {r["key"]: r["path"] for r in RT.discover_preds(t.spark, _preds_folder(t, ["m1/seed0"])).collect()}
    read = lambda key: P.read_preds(t.spark, found[key]).withColumn("split", F.lit(key.split("/")[1]))
    keys = sorted(found)
    preds = read(keys[0])
    for key in keys[1:]:
        preds = preds.unionByName(read(key))
    # Scores in files carry the noise of a logit and back; ties are those of six decimals.
    preds = r6(preds, "video_score")
    thr = roc.threshold_value(preds.where("split = 'val'"), "label", "video_score")
    return r6(figure_data(preds, thr, "video_id", "val"), "x", "y")
