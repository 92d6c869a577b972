"""Reports of whole jobs: findings as (severity, title, subject) rows, audits and figures in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diagnose as G
from ..operators import manifest as MF
from ..operators import metrics as M
from ..operators import roc
from ..operators import runs as RN

FINDING = ["severity", "title", "subject", "n"]


def severity_rank(severity="severity") -> Column:
    """Blockers first, then warnings, then notes."""
    return F.array_position(F.lit(["blocker", "warn", "info"]), F.col(severity))


def curation_findings(m: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Audio coverage, leakage, skew and split findings of a manifest, worst first."""
    overlap = MF.identity_overlap(m).groupBy("dataset", "pair").agg(F.count(F.lit(1)).alias("n"))
    audio = MF.audio_evidence(m).where("severity IS NOT NULL")
    skewed = MF.skew(m)
    gone = MF.missing_splits(m)
    rows = [
        overlap.select(F.lit("blocker").alias("severity"), F.lit("identity overlap").alias("title"), F.concat_ws(":", "dataset", "pair").alias("subject"), "n"),
        audio.select("severity", F.lit("audio coverage").alias("title"), F.col("dataset").alias("subject"), F.col("with_audio").alias("n")),
        skewed.where("balance_severity IS NOT NULL").select(F.col("balance_severity").alias("severity"), F.lit("class balance").alias("title"), F.col("dataset").alias("subject"), F.col("n_fake").alias("n")),
        skewed.where("method_severity IS NOT NULL").select(F.col("method_severity").alias("severity"), F.lit("method balance").alias("title"), F.col("dataset").alias("subject"), F.col("n_methods").alias("n")),
        gone.select(F.lit("warn").alias("severity"), F.lit("missing splits").alias("title"), F.concat_ws(":", F.col("dataset"), F.array_join("missing", ",")).alias("subject"), "n"),
    ]
    if classes is not None:
        kinds = classes.groupBy("kind").agg(F.sum("n_pairs").alias("n"))
        rows.append(
            kinds.select(
                F.when(F.col("kind") == "split", "blocker").otherwise("warn").alias("severity"),
                F.lit("near duplicates").alias("title"), F.col("kind").alias("subject"), "n",
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(severity_rank(), "title", "subject")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def long_form(df: DataFrame, part: str, subject: Column, names: list[str]) -> DataFrame:
    """(part, subject, name, value): one row per named number."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(part).alias("part"), subject.cast("string").alias("subject"), F.inline(pairs))


def manifest_audit(m: DataFrame, classes: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """What a build is checked by: totals, counts per split and method, audio evidence, leaks."""
    leaks = ["identity_overlaps", "label_conflicts", "split_duplicates", "cross_dataset_duplicates", "missing_files", "ok"]
    return _stacked(
        [
            long_form(MF.totals(m), "total", F.lit("all"), ["videos", "datasets"]),
            long_form(MF.summarise(m), "split", F.concat_ws("/", "dataset", "split"), ["n", "n_real", "n_fake", "n_audio", "n_identities"]),
            long_form(MF.method_counts(m), "method", F.col("forgery_method"), ["n"]),
            long_form(MF.audio_evidence(m), "audio", F.col("dataset"), ["n", "with_audio", "pct"]),
            long_form(MF.leak_report(m, classes, listing), "leak", F.lit("all"), leaks),
        ]
    )


def figure_data(preds: DataFrame, thr: float, row_id: str, base: str, by: str = "split", method: str = "dataset", n_bins: int = 10) -> DataFrame:
    """(figure, series, label, x, y): the points of every figure, each value once.

    Figures are ``roc`` (label: threshold), ``auc`` (point, lo, hi), ``reliability`` (label:
    rows in the bin), ``ece``, ``risk`` (label: rank), ``methods`` (AUC per method and
    series) and ``gap`` (AUC of ``base`` less that of another series). ``thr`` comes from
    validation.
    """

    def points(df: DataFrame, figure: str, series: Column, label: Column, x: Column, y: Column) -> DataFrame:
        nothing = lambda c: F.lit(None) if c is None else c
        return df.select(F.lit(figure).alias("figure"), series.cast("string").alias("series"), nothing(label).cast("double").alias("label"), nothing(x).cast("double").alias("x"), nothing(y).cast("double").alias("y"))

    s = F.col(by)
    ci = roc.delong_ci(preds, "label", "video_score", [by], row_id=row_id)
    bounds = F.inline(F.array(*[F.struct(F.lit(float(i)).alias("i"), F.col(k).alias("v")) for i, k in enumerate(("auc", "auc_lo", "auc_hi"))]))
    per_method = roc.auc(preds, "label", "video_score", [by, method])
    own = roc.auc(preds, "label", "video_score", [by])
    other = own.where(s != base)
    gaps = other.join(own.where(s == base).select(F.col("auc").alias("_base")), F.lit(True))
    return _stacked(
        [
            points(roc.roc_points(preds, "label", "video_score", [by]), "roc", s, F.col("threshold"), F.col("fpr"), F.col("tpr")),
            points(ci.select(by, bounds), "auc", s, None, F.col("i"), F.col("v")),
            points(M.reliability(preds, "label", "video_score", n_bins, [by]).where("n > 0"), "reliability", s, F.col("n"), F.col("centre"), F.col("observed")),
            points(M.ece(preds, "label", "video_score", n_bins, by=[by]), "ece", s, None, None, F.col("ece")),
            points(M.risk_coverage(preds, "label", "video_score", thr, row_id, [by]), "risk", s, F.col("rank"), F.col("coverage"), F.col("risk")),
            points(per_method, "methods", F.concat_ws("/", by, method), None, None, F.col("auc")),
            points(gaps, "gap", s, None, None, F.col("_base") - F.col("auc")),
        ]
    )


def run_findings(listing: DataFrame, epochs: DataFrame, logs: DataFrame) -> DataFrame:
    """(severity, title, subject) of runs: failed ones, stalled or too good validation, diverged logs.

    ``listing`` has (run, name) of files, ``epochs`` (run, epoch, val_auc), ``logs`` (run, name, text).
    """
    row = lambda severity, title: F.struct(F.lit(severity).alias("severity"), title.alias("title"))
    flags = F.array_compact(
        F.array(
            F.when(F.col("stall_warning"), row("warn", F.lit("stalled"))),
            F.when(F.col("suspiciously_high"), row("blocker", F.lit("too good too early"))),
        )
    )
    subject = F.col("run").cast("string").alias("subject")
    return _stacked(
        [
            RN.run_status(listing).where("status = 'failed'").select(F.lit("blocker").alias("severity"), F.lit("run failed").alias("title"), subject),
            RN.val_trend(epochs).select(F.inline(flags), subject),
            X.divergence(logs).select(F.lit("blocker").alias("severity"), F.col("reason").alias("title"), F.concat_ws(":", "run", "source").alias("subject")),
        ]
    )


def paper_findings(claims: DataFrame, cells: DataFrame, texts: DataFrame, banned: list[str], pattern: str = X.OVERCLAIM) -> DataFrame:
    """(severity, title, subject, n): claims against results, over-claims and banned tokens in ``texts`` (doc_id, text)."""
    found = G.claim_findings(G.claim_verdicts(claims, cells))
    over = X.overclaims(texts, "doc_id", pattern=pattern).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    tokens = X.banned_tokens(texts, "doc_id", banned).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return _stacked(
        [
            found.select("severity", "title", F.lit("all").alias("subject"), F.col("n").cast("bigint").alias("n")),
            over.select(F.lit("warn").alias("severity"), F.lit("over-claims").alias("title"), F.col("doc_id").cast("string").alias("subject"), "n"),
            tokens.select(F.lit("blocker").alias("severity"), F.lit("banned token").alias("title"), F.col("token").alias("subject"), "n"),
        ]
    )
