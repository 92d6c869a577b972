"""Experiment tables: seeds, gaps, slices, status and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .metrics import cross_gap

SEED_METRICS = ["auc", "accuracy", "f1", "eer", "ece"]


def aggregate_seeds(runs: DataFrame, metrics: Sequence[str] = SEED_METRICS) -> DataFrame:
    """Mean and sample deviation over seeds; one seed has no deviation and is marked."""
    base = runs.where(~F.col("is_breakdown")) if "is_breakdown" in runs.columns else runs
    return (
        base.groupBy("exp", "split")
        .agg(
            F.countDistinct("seed").alias("n_seeds"),
            F.min_by("n", "seed").alias("n"),
            *[F.avg(m).alias(f"{m}_mean") for m in metrics],
            *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
        )
        .withColumn("single_seed", F.col("n_seeds") < 2)
    )


def cross_table(seeds: DataFrame, base: str = "val") -> DataFrame:
    """In-dataset against cross-dataset AUC per experiment, from seed means."""
    return cross_gap(seeds, base, auc="auc_mean")


def method_matrix(breakdowns: DataFrame, splits: Sequence[str] | None = None) -> DataFrame:
    """Method by split AUC from slice names such as ``test/forgery_method=x``; gaps are 0."""
    rows = breakdowns.where(F.col("name").contains("forgery_method=")).select(
        F.regexp_extract("name", r"forgery_method=(.*)$", 1).alias("method"),
        F.regexp_extract("name", r"^([^/]*)/", 1).alias("split"),
        "auc",
    )
    wide = rows.groupBy("method").pivot("split", list(splits) if splits else None).agg(F.first("auc", True))
    return wide.na.fill(0.0)


def untrustworthy(runs: DataFrame) -> DataFrame:
    """Experiments with a degenerate calibration or a dirty working tree."""
    bad = runs.select(
        "exp",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("calibration_degenerate"), "degenerate calibration"),
                    F.when(F.col("git_sha").endswith("-dirty"), "dirty tree"),
                )
            )
        ).alias("flag"),
    )
    return bad.groupBy("exp", "flag").agg(F.count(F.lit(1)).alias("n_rows"))


def run_status(listing: DataFrame) -> DataFrame:
    """done / running / failed per run from the file names it holds."""
    has = lambda name: F.max((F.col("name") == name).cast("int")) == 1
    return listing.groupBy("run").agg(
        F.when(has("preds_val.csv") & has("summary.json"), "done")
        .when(has("metrics.jsonl"), "running")
        .otherwise("failed")
        .alias("status")
    )


def val_trend(epochs: DataFrame, run: str = "run") -> DataFrame:
    """Best epoch (the earliest on ties), epochs since, and signs of leakage or stall."""
    t = epochs.where("val_auc IS NOT NULL").groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.max(F.struct("val_auc", (-F.col("epoch")).alias("e"))).alias("best"),
        F.max("epoch").alias("last"),
    )
    best_epoch = -F.col("best.e")
    return t.select(
        run,
        "epochs",
        half_up("best.val_auc", 4).alias("best"),
        best_epoch.alias("best_epoch"),
        (F.col("last") - best_epoch).alias("stalled_epochs"),
        ((F.col("best.val_auc") > 0.995) & (best_epoch <= 1) & (F.col("epochs") > 1)).alias("suspiciously_high"),
        (F.col("last") - best_epoch >= 4).alias("stall_warning"),
    )
