"""Prediction tables: thirteen columns in CSV, JSON inside three of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up, sigmoid
from ..operators.calibration import Calibration, abstains, energy, probability
from ..schemas import PREDS, require_columns


def read_preds(spark: SparkSession, path: str) -> DataFrame:
    """Scan prediction CSVs by name; a file without the contract columns is refused.

    The header is read from the file, so columns may come in any order.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    require_columns(raw, PREDS.names, path)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDS])


def parsed(preds: DataFrame) -> DataFrame:
    """JSON columns as arrays and maps."""
    return preds.withColumns(
        {
            "frame_scores": F.from_json("frame_scores", "array<double>"),
            "sync_feats": F.from_json("sync_feats", "map<string,double>"),
            "stream_scores": F.from_json("stream_scores", "map<string,double>"),
        }
    )


def to_preds(df: DataFrame, calibration: Calibration | None = None) -> DataFrame:
    """The contract row of a logit: scores, abstention, novelty, JSON columns.

    ``frame_scores`` are rounded to five decimals. Without a calibration the
    probability is the score and nothing abstains. An ``ood_score`` column wins over
    the energy score.
    """
    prob = sigmoid("logit") if calibration is None else probability("logit", calibration)
    out = df.withColumns({"video_score": sigmoid("logit"), "calibrated_prob": prob})
    out = out.withColumn("abstain", F.lit(False) if calibration is None else abstains("calibrated_prob", calibration))
    json_or = lambda name, typ, empty: (
        F.to_json(F.col(name)) if name in df.columns else F.lit(empty)
    )
    frames = (
        F.to_json(F.transform("frame_scores", lambda x: half_up(x, 5))) if "frame_scores" in df.columns else F.lit("[]")
    )
    return out.select(
        "video_id",
        F.col("label").cast("int").alias("label"),
        "dataset",
        "forgery_method",
        F.lit("unknown").alias("compression"),
        "video_score",
        "calibrated_prob",
        frames.alias("frame_scores"),
        json_or("sync_feats", "map<string,double>", "{}").alias("sync_feats"),
        json_or("stream_scores", "map<string,double>", "{}").alias("stream_scores"),
        (F.col("ood_score") if "ood_score" in df.columns else energy("logit")).alias("ood_score"),
        "has_audio",
        "abstain",
    )


def write_preds(df: DataFrame, path: str, calibration: Calibration | None = None) -> None:
    to_preds(df, calibration).write.mode("errorifexists").csv(path, header=True, escape='"')
