"""Monitoring: stability, verdict counts, drift reports, job state and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import closed_open_bin, half_up

# Alert limits and histogram edges.
PSI_MODERATE, PSI_SIGNIFICANT = 0.10, 0.25
MAX_OOD_RATE, MAX_NO_FACE_RATE, MAX_AUDIO_SHIFT, SMALL_HEIGHT = 0.30, 0.25, 0.5, 360
WINDOW, MIN_SAMPLES, TOP_CODECS = 500, 50, 5
PROB_EDGES = [i / 10 for i in range(11)]
STAGE_EDGES = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0]
JOB_EDGES = [1.0, 2.0, 5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 120.0]
UPLOAD_EDGES = [1e5, 1e6, 5e6, 1e7, 2.5e7, 5e7, 1e8]
MAX_SPREAD = 0.15
TERMINAL = ["done", "failed", "cancelled"]
ACTIVE = ["queued", "running"]


def stability(
    variants: DataFrame, key: str = "video_id", original: str = "orig", max_spread: float = MAX_SPREAD
) -> DataFrame:
    """Agreement and spread of a clip's variants against its original scoring.

    Rows are (key, variant, verdict, prob, error); variants that failed are counted but
    not scored. Nothing scored is not stable.
    """
    is_orig = F.col("variant") == original
    scored = ~is_orig & (F.coalesce("error", F.lit("")) == "")
    t = variants.groupBy(key).agg(
        F.max(F.when(is_orig, F.col("verdict"))).alias("original_verdict"),
        F.max(F.when(is_orig, F.col("prob"))).alias("original_prob"),
        F.max(F.when(scored, F.col("prob"))).alias("_hi"),
        F.min(F.when(scored, F.col("prob"))).alias("_lo"),
        F.count(F.when(scored, 1)).alias("n_scored"),
        F.count(F.when(~is_orig & ~scored, 1)).alias("n_failed"),
        *[
            F.count(F.when(scored & (F.col("verdict") == v), 1)).alias(f"_{v}")
            for v in ("likely_authentic", "likely_manipulated", "inconclusive")
        ],
    )
    same = F.lit(0)
    for v in ("likely_authentic", "likely_manipulated", "inconclusive"):
        same = F.when(F.col("original_verdict") == v, F.col(f"_{v}")).otherwise(same)
    agreement = F.when(F.col("n_scored") > 0, same / F.col("n_scored")).otherwise(0.0)
    p = F.col("original_prob")
    spread = F.greatest(p, F.col("_hi")) - F.least(p, F.col("_lo"))
    return t.select(
        key,
        "original_verdict",
        "n_scored",
        "n_failed",
        half_up(agreement, 4).alias("verdict_agreement"),
        half_up(spread, 4).alias("prob_spread"),
        ((F.col("n_scored") > 0) & (agreement == 1.0) & (spread <= max_spread)).alias("stable"),
    )


def verdict_counts(rows: DataFrame) -> DataFrame:
    """Rows per verdict, errors among them."""
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# drift
# --------------------------------------------------------------------------
def drift_baseline(preds: DataFrame, n_bins: int = 10, source: str | None = None) -> DataFrame:
    """One row of bucket counts, mean, audio rate and size from validation predictions; ``source`` names them."""
    p = F.coalesce("calibrated_prob", "video_score") if "calibrated_prob" in preds.columns else F.col("video_score")
    b = preds.withColumn("_b", closed_open_bin(p, n_bins))
    counts = F.array(*[F.count(F.when(F.col("_b") == i, 1)) for i in range(n_bins)])
    return b.agg(
        counts.alias("bins"),
        F.avg(p).alias("score_mean"),
        F.avg(F.col("has_audio").cast("double")).alias("audio_rate"),
        F.count(p).alias("n"),
        F.lit(source).alias("source"),
    )


def last_n(df: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows overall (a top-k), or per key."""
    if not by:
        return df.orderBy(*[F.desc(o) for o in order]).limit(n)
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def psi_of_bins(base: Column, live: Column, n_bins: int = 10) -> Column:
    """PSI of two arrays of bucket counts."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    eps = 1e-6
    share = lambda x, t: (x + eps) / (t + eps * n_bins)
    tb, tl = total(base), total(live)
    terms = F.zip_with(base, live, lambda b, v: (share(v, tl) - share(b, tb)) * F.log(share(v, tl) / share(b, tb)))
    return F.when((tb >= 10) & (tl >= 10), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def drift_labels(df: DataFrame) -> DataFrame:
    """Readiness, drift level and alerts from a row of drift statistics."""
    psi, ready = F.col("score_psi"), F.col("n_observed") >= MIN_SAMPLES
    level = (
        F.when(psi.isNull(), "unknown")
        .when(psi > PSI_SIGNIFICANT, "significant")
        .when(psi > PSI_MODERATE, "moderate")
        .otherwise("stable")
    )
    alerts = F.array_compact(
        F.array(
            F.when(psi > PSI_SIGNIFICANT, F.lit("score distribution")),
            F.when(F.col("ood_rate") > MAX_OOD_RATE, F.lit("out of distribution")),
            F.when(F.col("no_face_rate") > MAX_NO_FACE_RATE, F.lit("no face")),
            F.when(F.abs(F.col("audio_rate_live") - F.col("audio_rate_baseline")) > MAX_AUDIO_SHIFT, F.lit("audio presence")),
        )
    )
    return df.withColumns(
        {"ready": ready, "score_drift": F.when(ready, level), "alerts": F.when(ready, alerts)}
    )


def drift_of_windows(
    scores: DataFrame, rows: DataFrame, totals: DataFrame, baseline: DataFrame, uploads: DataFrame | None = None,
    codecs: DataFrame | None = None, n_bins: int = 10,
) -> DataFrame:
    """The drift report of what a monitor keeps.

    ``scores`` (calibrated_prob), ``rows`` (has_audio, n_faces_found) and ``uploads``
    (duration_s, height) are the newest of each, in windows of their own: a result
    without a probability takes no place among the scores. ``totals`` (total, ood, held)
    and ``codecs`` (codec, n) are of all time. Before anything was seen, rates are 0.
    """
    b = closed_open_bin(F.col("calibrated_prob"), n_bins)
    live = scores.agg(
        F.count("calibrated_prob").alias("n_observed"),
        F.avg("calibrated_prob").alias("score_mean_live"),
        F.array(*[F.count(F.when(b == i, 1)) for i in range(n_bins)]).alias("live_bins"),
    )
    audio = F.coalesce(F.col("has_audio"), F.lit(False)).cast("double")
    faces = F.coalesce(F.col("n_faces_found"), F.lit(0))
    seen = rows.agg(
        F.coalesce(F.avg(audio), F.lit(0.0)).alias("audio_rate_live"),
        F.avg((faces == 0).cast("double")).alias("no_face_rate"),
        F.percentile(faces, 0.5).alias("median_faces"),
    )
    share = lambda k: F.coalesce(F.try_divide(F.col(k).cast("double"), F.col("total")), F.lit(0.0))
    rates = totals.select(share("ood").alias("ood_rate"), share("held").alias("abstain_rate"))
    base = baseline.select(
        F.col("bins"), F.col("score_mean").alias("score_mean_baseline"), F.col("audio_rate").alias("audio_rate_baseline"),
        F.col("n").alias("baseline_n"), F.col("source").alias("baseline_source"),
    )
    row = live.crossJoin(seen).crossJoin(rates).crossJoin(base)
    if uploads is not None:
        row = row.crossJoin(
            uploads.agg(
                F.percentile("duration_s", 0.5).alias("median_duration_s"),
                F.percentile("height", 0.5).alias("median_height_px"),
                F.avg((F.col("height") < SMALL_HEIGHT).cast("double")).alias("small_video_rate"),
            )
        )
    if codecs is not None:
        top = codecs.orderBy(F.desc("n"), "codec").limit(TOP_CODECS).agg(F.collect_list(F.struct((-F.col("n")).alias("_o"), "codec", "n")).alias("_c"))
        named = F.map_from_entries(F.transform(F.sort_array("_c"), lambda c: F.struct(c["codec"], c["n"])))
        row = row.crossJoin(top.select(named.alias("codecs")))
    row = row.withColumn("score_psi", psi_of_bins(F.col("bins"), F.col("live_bins"), n_bins)).drop("bins", "live_bins")
    return drift_labels(row)


def result_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("ood_flag"), 1)).alias("ood"),
        F.count(F.when(F.col("verdict") == "inconclusive", 1)).alias("held"),
    )


def drift_report(
    results: DataFrame, baseline: DataFrame, uploads: DataFrame | None = None, order: Sequence[str] = ("ts", "seq"),
    window: int = WINDOW, n_bins: int = 10,
) -> DataFrame:
    """Batch drift report: recent windows against the baseline, all-time totals beside.

    ``results`` has calibrated_prob, has_audio, n_faces_found, ood_flag, verdict;
    ``uploads`` duration_s, height, codec. The windows are top-``window`` reports; totals
    are plain aggregates.
    """
    scores = last_n(results.where("calibrated_prob IS NOT NULL"), order, window)
    ups = None if uploads is None else last_n(uploads, order, window)
    codecs = None if uploads is None else uploads.where("codec IS NOT NULL").groupBy("codec").agg(F.count(F.lit(1)).alias("n"))
    return drift_of_windows(scores, last_n(results, order, window), result_totals(results), baseline, ups, codecs, n_bins)


def top_codecs(uploads: DataFrame, k: int = 5) -> DataFrame:
    return uploads.groupBy("codec").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "codec").limit(k)


# --------------------------------------------------------------------------
# jobs
# --------------------------------------------------------------------------
JOB_FIELDS = ["state", "stage", "filename", "storage_key", "error", "result"]


def job_state(changes: DataFrame, at: Sequence[str] = ("updated_us", "seq")) -> DataFrame:
    """Latest value of every job field; a null in a change leaves the field as it was.

    One aggregate with map-side combine: a job with very many changes shrinks before
    the shuffle.
    """
    key = F.struct(*at)
    fields = [k for k in JOB_FIELDS if k in changes.columns]
    return changes.groupBy("job_id").agg(
        F.min(at[0]).alias("created_us"),
        F.max(at[0]).alias("updated_us"),
        *[F.max_by(k, F.when(F.col(k).isNotNull(), key)).alias(k) for k in fields],
    )


def upsert_jobs(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply changes to a job table; changes to unknown jobs are ignored."""
    fields = [k for k in JOB_FIELDS if k in base.columns and k in changes.columns]
    new = job_state(changes)
    got = base.alias("o").join(new.alias("n"), "job_id", "left")
    return got.select(
        "job_id",
        *[
            F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) if k in fields or k == "updated_us" else F.col(f"o.{k}")
            for k in base.columns
            if k != "job_id"
        ],
    )


def recent(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` newest jobs."""
    return jobs.orderBy(F.desc("created_us"), F.desc("job_id")).limit(limit)


def queue_depth(jobs: DataFrame) -> DataFrame:
    """How many of all jobs wait or run."""
    return jobs.agg(F.count(F.when(F.col("state").isin(ACTIVE), 1)).alias("depth"))


def purge(jobs: DataFrame, now_us, hours: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) jobs by age; expired ones name the artefacts to delete."""
    limit = F.lit(now_us) if not isinstance(now_us, Column) else now_us
    old = F.col("created_us") < limit - F.lit(int(hours * 3_600_000_000))
    return jobs.where(~old), jobs.where(old)


def rate_breaches(requests: DataFrame, limit: int, minutes: int = 1) -> DataFrame:
    """Clients above ``limit`` requests in a calendar window."""
    w = F.window("ts", f"{minutes} minute")
    return (
        requests.groupBy("client", w.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select("client", F.col("w.start").alias("start"), "n")
    )


def histogram(df: DataFrame, value: Column, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` bucket counts, the last one being +infinity.

    Each row is counted in its own bucket first; buckets are summed up afterwards, so
    rows are not copied once per bucket.
    """
    all_edges = [*edges, float("inf")]
    slot = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        slot = F.when(value <= edges[i], i).otherwise(slot)
    own = df.where(value.isNotNull()).groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("k"))
    wide = own.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("slot") <= i, F.col("k"))), F.lit(0)).alias(f"b{i}") for i in range(len(all_edges))]
    )
    pairs = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(all_edges)])
    return wide.select(*by, F.inline(pairs))
