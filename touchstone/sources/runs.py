"""Run trees: ``<root>/<exp>/seed<k>/`` with reports, stamps, calibration and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.runs import aggregate_seeds, cross_table

#: Numbers a metric report carries.
REPORT = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("n", "n_pos", "n_neg")]
    + [T.StructField("name", T.StringType()), T.StructField("threshold_source", T.StringType())]
    + [
        T.StructField(k, T.DoubleType())
        for k in (
            "threshold", "auc", "auc_lo", "auc_hi", "pauc10", "ap", "eer", "tpr_at_1fpr", "tpr_at_5fpr", "tpr_at_10fpr",
            "accuracy", "precision", "recall", "f1", "ece", "mce", "brier", "abstain_rate", "risk_at_90cov",
            "risk_at_80cov", "risk_at_70cov",
        )
    ]
)


def run_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def _json_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.text(f"{root}/*/seed*/{name}", wholetext=True).select(
        run_dir(F.input_file_name()).alias("run_dir"), F.col("value")
    )


def _has(spark: SparkSession, root: str, name: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/seed*/{name}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop)
    return found is not None and len(found) > 0


def collect_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per (experiment, seed, split), with stamp and calibration of its run."""
    reports = _json_files(spark, root, "metrics_report.json").select(
        "run_dir", F.explode(F.from_json("value", T.MapType(T.StringType(), REPORT))).alias("split", "r")
    )
    none = spark.createDataFrame([], "run_dir string, value string")
    stamps = _json_files(spark, root, "stamp.json") if _has(spark, root, "stamp.json") else none
    cals = _json_files(spark, root, "calibration.json") if _has(spark, root, "calibration.json") else none
    stamps = stamps.select(
        "run_dir",
        F.get_json_object("value", "$.git_sha").alias("git_sha"),
        F.get_json_object("value", "$.config_hash").alias("config_hash"),
    )
    cals = cals.select("run_dir", (F.get_json_object("value", "$.degenerate") == "true").alias("calibration_degenerate"))
    return (
        reports.join(stamps, "run_dir", "left")
        .join(cals, "run_dir", "left")
        .select(
            F.regexp_extract("run_dir", r"([^/]+)/seed\d+$", 1).alias("exp"),
            F.regexp_extract("run_dir", r"/seed(\d+)$", 1).cast("int").alias("seed"),
            "split",
            (F.instr("split", "/") > 0).alias("is_breakdown"),
            F.coalesce("git_sha", F.lit("?")).alias("git_sha"),
            F.coalesce("config_hash", F.lit("?")).alias("config_hash"),
            "calibration_degenerate",
            "run_dir",
            "r.*",
        )
    )


def discover_preds(spark: SparkSession, root: str) -> DataFrame:
    """(key, path) of prediction files, keyed ``exp/split``; the first seed wins.

    A file that Spark wrote is a folder of parts; its path is the folder's, not a part's.
    """
    files = spark.read.format("binaryFile").load(f"{root}/*/seed*/preds_*.csv")
    files = files.select(F.regexp_extract("path", r"^(.*/seed\d+/preds_[^/]+\.csv)(?:/[^/]*)?$", 1).alias("path"))
    parts = r"([^/]+)/seed(\d+)/preds_([^/]+)\.csv"
    key = F.concat_ws("/", F.regexp_extract("path", parts, 1), F.regexp_extract("path", parts, 3))
    return files.groupBy(key.alias("key")).agg(F.min("path").alias("path"))


def read_epochs(spark: SparkSession, root: str, schema: str = "epoch int, val_auc double") -> DataFrame:
    """Epoch lines of every run; lines without ``val_auc`` and blank lines are skipped."""
    lines = spark.read.schema(schema).json(f"{root}/*/seed*/metrics.jsonl")
    where = run_dir(F.input_file_name())
    return lines.withColumn("run", F.regexp_extract(where, r"([^/]+/seed\d+)$", 1)).where("val_auc IS NOT NULL")


def write_reports(reports: DataFrame, path: str) -> None:
    """Metric rows as CSV (flat) and JSON (with the confusion matrix)."""
    flat = reports.drop("confusion")
    flat.write.mode("errorifexists").csv(f"{path}/csv", header=True)
    reports.write.mode("errorifexists").json(f"{path}/json")


def write_results(runs: DataFrame, out: str) -> list[str]:
    """The result tables of a set of runs; nothing at all when there are none."""
    if runs.isEmpty():
        return []
    seeds = aggregate_seeds(runs)
    tables = {
        "all_runs": runs,
        "by_experiment": seeds,
        "cross_dataset_gap": cross_table(seeds),
        "breakdowns": runs.where("is_breakdown"),
    }
    written = []
    for name, df in tables.items():
        if name in ("all_runs", "by_experiment") or not df.isEmpty():
            df.write.mode("errorifexists").csv(f"{out}/{name}", header=True)
            written.append(name)
    return written
