"""Claims, verdict tables, audit log and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import record_hash

CLAIMS = "section string, claim_id string, sentence_fragment string, results_file string, column string, row_selector string, expected_value string, status string"


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims CSV; comment lines are dropped before the header is looked for."""
    return spark.read.csv(path, header=True, comment="#", schema=CLAIMS, enforceSchema=False)


def write_verdicts(df: DataFrame, path: str, fmt: str) -> None:
    """Batch verdicts as ``csv`` or ``jsonl``; any other format is refused."""
    if fmt not in ("csv", "jsonl"):
        raise ValueError("verdicts are written as csv or jsonl")
    w = df.write.mode("errorifexists")
    w.csv(path, header=True) if fmt == "csv" else w.json(path)


def audit_record(df: DataFrame, agent: Column, action: Column, inputs: str, output: str) -> DataFrame:
    """Audit rows: hashes and a short preview, never the raw payloads."""
    return df.select(
        F.coalesce(F.col("ts"), F.current_timestamp()).alias("ts") if "ts" in df.columns else F.current_timestamp().alias("ts"),
        agent.alias("agent"),
        action.alias("action"),
        record_hash(inputs, 16).alias("inputs_hash"),
        record_hash(output, 16).alias("output_hash"),
        F.substring(output, 1, 280).alias("output_preview"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(
        path, schema="ts timestamp, agent string, action string, inputs_hash string, output_hash string, output_preview string"
    )


def read_jobs(spark: SparkSession, source: str, **options) -> DataFrame:
    """A job table from parquet, or over JDBC when options name a ``dbtable``."""
    df = (
        spark.read.format("jdbc").options(url=source, **options).load()
        if "dbtable" in options
        else spark.read.parquet(source)
    )
    if "result" not in df.columns:
        return df
    return df.withColumns(
        {
            "verdict": F.get_json_object("result", "$.verdict"),
            "calibrated_prob": F.get_json_object("result", "$.calibrated_prob").cast("double"),
            "model_version": F.get_json_object("result", "$.model_version"),
        }
    )
