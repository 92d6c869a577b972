"""Table contracts: columns, allowed values and schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MANIFEST_VERSION = 1
PREDS_VERSION = 1
CACHE_VERSION = 1
VERSION_KEY = "schema_version"

# The names a manifest may use.
DATASETS = ["ffpp", "celebdf", "dfdc", "fakeavceleb", "lavdf", "deeperforensics", "custom"]
SPLITS = ["train", "val", "test"]
COMPRESSIONS = ["raw", "c0", "c23", "c40", "crf23", "crf32", "crf40", "unknown"]
VERDICTS = ["likely_authentic", "likely_manipulated", "inconclusive"]
RELIABILITY_FIELDS = ["audio_snr", "face_conf", "mouth_vis", "blur"]

MANIFEST = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("forgery_method", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("has_audio", T.BooleanType()),
        T.StructField("source_identity", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("n_frames", T.IntegerType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("sha256", T.StringType()),
    ]
)

PREDS = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("forgery_method", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("video_score", T.DoubleType()),
        T.StructField("calibrated_prob", T.DoubleType()),
        T.StructField("frame_scores", T.StringType()),
        T.StructField("sync_feats", T.StringType()),
        T.StructField("stream_scores", T.StringType()),
        T.StructField("ood_score", T.DoubleType()),
        T.StructField("has_audio", T.BooleanType()),
        T.StructField("abstain", T.BooleanType()),
    ]
)

STREAM_SCORE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("available", T.BooleanType()),
        T.StructField("reliability", T.DoubleType()),
        T.StructField("note", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("calibrated_prob", T.DoubleType()),
        T.StructField("conformal_lo", T.DoubleType()),
        T.StructField("conformal_hi", T.DoubleType()),
        T.StructField("raw_score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("streams", T.ArrayType(STREAM_SCORE)),
        T.StructField("frame_scores", T.ArrayType(T.DoubleType())),
        T.StructField("frame_timestamps", T.ArrayType(T.DoubleType())),
        T.StructField("sync_curve", T.ArrayType(T.DoubleType())),
        T.StructField("sync_offset_ms", T.DoubleType()),
        T.StructField("sync_confidence", T.DoubleType()),
        T.StructField("gate_weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("ood_score", T.DoubleType()),
        T.StructField("ood_flag", T.BooleanType()),
        T.StructField("has_audio", T.BooleanType()),
        T.StructField("n_faces_found", T.IntegerType()),
        T.StructField("reliability", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("explanation", T.StringType()),
        T.StructField("explanation_source", T.StringType()),
        T.StructField("latency_ms", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("calibration_degenerate", T.BooleanType()),
    ]
)


class SchemaError(ValueError):
    """A table does not have the columns or the version its contract asks for."""


def require_columns(df: DataFrame, columns, what: str) -> DataFrame:
    """Refuse a table that lacks contract columns, naming them in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"{what}: missing columns {missing}")
    return df


def stamp_version(df: DataFrame, column: str, version: int) -> DataFrame:
    """Keep the schema version in field metadata, which parquet round-trips."""
    return df.withMetadata(column, {VERSION_KEY: version})


def read_version(df: DataFrame, column: str) -> int:
    return int(df.schema[column].metadata.get(VERSION_KEY, 0))
