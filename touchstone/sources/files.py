"""File listings, fingerprints and side tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: suffixes that count as video.
VIDEO_EXTS = [".mp4", ".avi", ".mov", ".mkv", ".webm"]


def list_files(
    spark: SparkSession, roots: Sequence[str] | str, exts: Sequence[str] = VIDEO_EXTS, recursive: bool = True
) -> DataFrame:
    """Distinct files under ``roots`` with an allowed suffix, whatever its case.

    Only names and sizes are read: without the ``content`` column the binary source
    opens no file. An unknown root raises.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (
        reader.load(roots)
        .select("path", "length", "modificationTime")
        .where(suffix.isin([e.lower() for e in exts]))
        .distinct()
    )


def collect_videos(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> DataFrame:
    return list_files(spark, paths, VIDEO_EXTS, recursive).select("path").orderBy("path")


def split_failures(df: DataFrame, error: str = "error", key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Good rows, and (key, error) of the bad ones. Bad rows never stop a job."""
    failed = F.coalesce(F.col(error) != "", F.lit(False))
    return df.where(~failed), df.where(failed).select(key, error)


def write_failures(bad: DataFrame, path: str) -> None:
    bad.write.mode("errorifexists").csv(path, sep="\t")
