"""Failure analysis of predictions, and reconciliation of written claims with results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .metrics import with_threshold
from .ordered import quantiles

AXES = ["forgery_method", "compression", "dataset", "has_audio"]
MIN_SLICE = 5


def with_metadata(preds: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions with five manifest columns; unknown clips keep nulls."""
    meta = manifest.select("video_id", "duration_s", "fps", "n_frames", "source_identity")
    return preds.drop("duration_s", "fps", "n_frames", "source_identity").join(meta, "video_id", "left")


def judged(preds: DataFrame, thr, prob: str = "calibrated_prob", label: str = "label") -> DataFrame:
    """Add ``correct`` and ``error_mag``, the distance past the threshold of a mistake."""
    df = with_threshold(preds, thr)
    right = (F.col(prob) >= F.col("threshold")).cast("int") == F.col(label)
    return df.withColumns(
        {"correct": right, "error_mag": F.when(right, 0.0).otherwise(F.abs(F.col(prob) - F.col("threshold")))}
    )


def slice_accuracy(p: DataFrame, axes: Sequence[str] = AXES, min_rows: int = MIN_SLICE) -> DataFrame:
    """Accuracy of every slice of every axis, with the worst slice of an axis flagged.

    Axes with a single value and slices under ``min_rows`` are left out. All axes are
    counted in one grouping-sets pass.
    """
    entries = ", ".join(f"named_struct('axis', '{a}', 'value', CAST(`{a}` AS STRING))" for a in axes)
    long = p.selectExpr("correct", f"inline(array({entries}))").where("value IS NOT NULL")
    per = long.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("ok"))
    overall = p.agg(F.avg(F.col("correct").cast("double")).alias("overall"))
    worst = per.groupBy("axis").agg(
        F.count(F.lit(1)).alias("k"),
        F.expr(f"min(CASE WHEN n >= {min_rows} THEN struct(ok / n AS acc, value) END)").alias("worst"),
    )
    out = per.join(worst, "axis").where(f"k >= 2 AND n >= {min_rows}").crossJoin(F.broadcast(overall))
    acc = F.col("ok") / F.col("n")
    flagged = (F.col("value") == F.col("worst.value")) & (F.col("overall") - acc > 0.10)
    return out.select("axis", "value", "n", acc.alias("accuracy"), "overall", flagged.alias("flagged"))


# What to try first for a weak slice of each axis.
ACTIONS = {
    "compression": "Increase degradation augmentation strength and re-check this slice.",
    "forgery_method": "Check that the method-balanced sampler runs; compare with self-blended training images.",
    "has_audio": "Weak without audio: raise modality dropout. Weak with audio: the gate may trust a noisy stream.",
}


def suggested_action(axis: str = "axis", value: str = "value") -> Column:
    out = F.concat(F.lit("Investigate the "), F.col(axis), F.lit("="), F.col(value), F.lit(" slice; stratify training across this axis."))
    for name, text in ACTIONS.items():
        out = F.when(F.col(axis) == name, text).otherwise(out)
    return out


def quartile_accuracy(p: DataFrame, col: str, min_rows: int = MIN_SLICE) -> DataFrame:
    """Accuracy per quarter of a number; bins are (lo, hi], equal edges fall together."""
    edges = quantiles(p, col, {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0})
    x = F.col(col)
    # The number of distinct inner edges below a value is its bin.
    below = sum(
        ((F.col(f"e{i}") > F.col(f"e{i - 1}")) & (x > F.col(f"e{i}"))).cast("int") for i in range(1, 4)
    )
    bins = (
        p.where(x.isNotNull())
        .crossJoin(F.broadcast(edges))
        .groupBy(below.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
        .where(F.col("n") >= min_rows)
    )
    span = bins.agg(
        F.count(F.lit(1)).alias("k"), (F.max("accuracy") - F.min("accuracy")).alias("range")
    )
    return bins.crossJoin(F.broadcast(span)).where("k >= 2").select("bin", "n", "accuracy", (F.col("range") > 0.12).alias("flagged"))


def worst_mistakes(p: DataFrame, k: int = 20, prob: str = "calibrated_prob") -> DataFrame:
    """The most confident mistakes: a top-k report."""
    return (
        p.where(~F.col("correct"))
        .orderBy(F.desc("error_mag"), "video_id")
        .limit(k)
        .select("video_id", "label", half_up(prob, 4).alias("prob"), F.col("forgery_method").alias("method"), "has_audio", "error_mag")
    )


def error_totals(p: DataFrame, abstain: str = "abstain", min_kept: int = 10) -> DataFrame:
    """Missed fakes, false accusations, and what abstaining does to accuracy."""
    ok = F.col("correct").cast("double")
    kept = ~F.col(abstain)
    t = p.agg(
        F.count(F.when((F.col("label") == 1) & ~F.col("correct"), 1)).alias("false_negatives"),
        F.count(F.when((F.col("label") == 0) & ~F.col("correct"), 1)).alias("false_positives"),
        F.avg(ok).alias("accuracy"),
        F.avg(F.when(kept, ok)).alias("accuracy_kept"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.avg(F.col(abstain).cast("double")).alias("abstain_rate"),
    )
    lift = F.when((F.col("n_kept") > min_kept) & (F.col("abstain_rate") > 0), F.col("accuracy_kept") - F.col("accuracy"))
    return t.withColumn("lift", lift).withColumn(
        "severity", F.when(F.col("lift").isNull(), None).when(F.col("lift") > 0.01, "info").otherwise("warn")
    )


def failure_findings(preds: DataFrame, thr, prob: str, axes: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Findings of a diagnosis as (severity, title, subject, value), worst first."""
    p = judged(preds, thr, prob)
    weak = slice_accuracy(p, axes).where("flagged").select(
        F.lit("warn").alias("severity"), F.lit("weak slice").alias("title"),
        F.concat_ws("=", "axis", "value").alias("subject"), half_up("accuracy", 4).alias("value"),
    )
    totals = error_totals(p)
    rows = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("info").alias("severity"), F.lit("missed fakes").alias("title"), F.lit("all").alias("subject"), F.col("false_negatives").cast("double").alias("value")),
                F.struct(F.lit("info").alias("severity"), F.lit("false accusations").alias("title"), F.lit("all").alias("subject"), F.col("false_positives").cast("double").alias("value")),
                F.struct(F.col("severity").alias("severity"), F.lit("abstention lift").alias("title"), F.lit("all").alias("subject"), half_up("lift", 4).alias("value")),
            )
        ).alias("f")
    ).select("f.*").where("severity IS NOT NULL")
    out = weak.unionByName(rows)
    for col in columns:
        q = quartile_accuracy(p, col).where("flagged").groupBy().agg(F.count(F.lit(1)).alias("k"), (F.max("accuracy") - F.min("accuracy")).alias("r"))
        out = out.unionByName(
            q.where("k > 0").select(F.lit("warn").alias("severity"), F.lit("accuracy varies").alias("title"), F.lit(col).alias("subject"), half_up("r", 4).alias("value"))
        )
    rank = F.array_position(F.lit(["blocker", "warn", "info"]), F.col("severity"))
    return out.orderBy(rank, "title", "subject")


# --------------------------------------------------------------------------
# claims against results
# --------------------------------------------------------------------------
def cells(results: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """A results table as rows (file, row, cols: map column -> text), for ``resolve_cells``.

    ``row`` is a sortable key of the table's own order columns.
    """
    text = {k: F.col(k).cast("string") for k in results.columns}
    pairs = [x for k, v in text.items() for x in (F.lit(k), v)]
    return results.select(
        F.lit(file).alias("file"), F.struct(*order).alias("row").cast("string"), F.create_map(*pairs).alias("cols")
    )


def resolve_cells(claims: DataFrame, results: DataFrame) -> DataFrame:
    """The first results cell each claim points at, as text in ``actual``.

    Every selector clause ``column=value`` must hold as text; clauses on columns that
    the file lacks are ignored. No file, no column or no row leaves null.
    """
    clauses = F.filter(F.split(F.coalesce("row_selector", F.lit("")), ";"), lambda s: F.instr(s, "=") > 0)
    parsed = F.transform(
        clauses,
        lambda s: F.struct(
            F.trim(F.substring_index(s, "=", 1)).alias("k"), F.trim(F.substr(s, F.instr(s, "=") + 1)).alias("v")
        ),
    )
    asked = claims.withColumn("_c", parsed)
    holds = F.forall(
        "_c",
        lambda q: ~F.array_contains(F.map_keys("cols"), q["k"])
        | F.coalesce(F.try_element_at(F.col("cols"), q["k"]) == q["v"], F.lit(False)),
    )
    hits = (
        asked.select("claim_id", "results_file", F.col("column").alias("_col"), "_c")
        .join(results, F.col("results_file") == F.col("file"))
        .where(holds & F.array_contains(F.map_keys("cols"), F.col("_col")))
        .groupBy("claim_id")
        .agg(F.min_by(F.struct(F.try_element_at(F.col("cols"), F.col("_col")).alias("v")), F.col("row")).alias("_a"))
    )
    return asked.drop("_c").join(hits, "claim_id", "left").withColumn("actual", F.col("_a.v")).drop("_a")


def claim_verdicts(claims: DataFrame, results: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """verified / mismatched / unbacked per claim."""
    got = resolve_cells(claims, results)
    expected = F.trim(F.coalesce("expected_value", F.lit("")))
    pending = (F.trim(F.coalesce("results_file", F.lit(""))) == "") | (F.upper(expected) == "PENDING")
    a, e = F.col("actual").try_cast("double"), expected.try_cast("double")
    differs = F.when(a.isNotNull() & e.isNotNull(), F.abs(a - e) > tolerance).otherwise(F.trim("actual") != expected)
    return got.withColumn(
        "verdict",
        F.when(pending, "unbacked").when(F.col("actual").isNull(), "unbacked").when(differs, "mismatched").otherwise("verified"),
    )


def claim_findings(verdicts: DataFrame) -> DataFrame:
    """Mismatches block; unbacked claims block unless nothing at all is backed."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    t = verdicts.agg(F.count(F.lit(1)).alias("n"), n("mismatched").alias("m"), n("unbacked").alias("u"), n("verified").alias("v"))
    entry = lambda cond, sev, title, k: F.when(cond, F.struct(sev.alias("severity"), F.lit(title).alias("title"), F.col(k).alias("n")))
    return t.select(
        F.explode(
            F.array_compact(
                F.array(
                    entry(F.col("m") > 0, F.lit("blocker"), "claims disagree with results", "m"),
                    entry(F.col("u") > 0, F.when(F.col("u") < F.col("n"), "blocker").otherwise("warn"), "claims without a number", "u"),
                    entry(F.col("v") > 0, F.lit("info"), "claims verified", "v"),
                )
            )
        ).alias("f")
    ).select("f.*")


def score_parity(a: DataFrame, b: DataFrame, key: str = "video_id", score: str = "score", tolerance: float = 1e-3) -> DataFrame:
    """Whether two scorings agree: largest gap, and rows only one side has."""
    both = a.select(key, F.col(score).alias("_a"), F.lit(1).alias("_ia")).join(
        b.select(key, F.col(score).alias("_b"), F.lit(1).alias("_ib")), key, "full"
    )
    t = both.agg(
        F.count(F.when(F.col("_ia").isNotNull() & F.col("_ib").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("_ib").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_ia").isNull(), 1)).alias("only_b"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_gap"),
    )
    ok = (F.col("max_gap") <= tolerance) & (F.col("only_a") + F.col("only_b") == 0)
    return t.withColumn("ok", F.coalesce(ok, F.lit(False)))
