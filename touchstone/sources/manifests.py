"""Manifest tables and the dataset layouts they are built from.

Each layout is a function from a file listing (and its metadata tables) to a partial
manifest; probing results are joined afterwards. Identities, tags and splits are column
expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_split
from ..functions.numeric import c
from ..operators.manifest import require_valid
from ..schemas import MANIFEST, MANIFEST_VERSION, SchemaError, read_version, require_columns, stamp_version
from .json_records import read_records


def read_manifest(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    dataset: str | None = None,
    has_audio: bool | None = None,
) -> DataFrame:
    """Scan with optional equality filters, which reach the parquet reader."""
    df = spark.read.parquet(path)
    require_columns(df, MANIFEST.names, path)
    found = read_version(df, "video_id")
    if found != MANIFEST_VERSION:
        raise SchemaError(f"{path}: manifest version {found}, this library reads {MANIFEST_VERSION}")
    for name, value in (("split", split), ("dataset", dataset), ("has_audio", has_audio)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def write_manifest(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a checked manifest, stamped with its version. Bad tables are refused."""
    good = require_valid(df).select(*MANIFEST.names)
    writer = stamp_version(good, "video_id", MANIFEST_VERSION).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# --------------------------------------------------------------------------
# names and identities
# --------------------------------------------------------------------------
def basename(path) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def pair_key(prefix: str, parts) -> Column:
    """Distinct identity parts in order, joined by ``+``."""
    return F.concat(F.lit(prefix), F.array_join(F.array_sort(F.array_distinct(parts)), "+"))


# Tags of the public datasets' layouts.
FFPP_METHODS = ["Deepfakes", "Face2Face", "FaceSwap", "NeuralTextures"]
FAV_COMBOS = {
    "RealVideo-RealAudio": (0, "real"),
    "FakeVideo-RealAudio": (1, "fav_fake_video"),
    "RealVideo-FakeAudio": (1, "fav_fake_audio"),
    "FakeVideo-FakeAudio": (1, "fav_fake_both"),
}
LAVDF_SPLITS = {"train": "train", "dev": "val", "val": "val", "test": "test"}


def deeperforensics_tag(folder) -> Column:
    """Method tag of a perturbation folder: its level, else its distortion."""
    pattern = r"^end_to_end(?:_level_(\d))?(?:_(\w+))?$"
    f = c(folder)
    level, kind = F.regexp_extract(f, pattern, 1), F.regexp_extract(f, pattern, 2)
    return (
        F.when(~f.rlike(pattern), F.concat(F.lit("dfo_"), f))
        .when(level != "", F.concat(F.lit("dfo_level"), level))
        .when(kind != "", F.concat(F.lit("dfo_"), kind))
        .otherwise("dfo_end_to_end")
    )


def lavdf_method(video, audio, label) -> Column:
    """Which track was altered, from two booleans and the label."""
    v, a = F.coalesce(c(video), F.lit(False)), F.coalesce(c(audio), F.lit(False))
    return (
        F.when(c(label) == 0, "real")
        .when(v & a, "lavdf_both")
        .when(a, "lavdf_audio")
        .when(v, "lavdf_video")
        .otherwise("lavdf_unknown")
    )


# --------------------------------------------------------------------------
# splits
# --------------------------------------------------------------------------
def read_official_splits(spark: SparkSession, folder: str) -> DataFrame:
    """(id, split) from ``train/val/test.json`` files of id pairs; the later file wins."""
    pairs = spark.read.text(f"{folder}/*.json", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("split"),
        F.explode(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType())))).alias("pair"),
    )
    rank = F.array_position(F.lit(["train", "val", "test"]), F.col("split"))
    return (
        pairs.where(rank > 0)
        .select(F.explode("pair").alias("id"), "split", rank.alias("r"))
        .groupBy("id")
        .agg(F.max_by("split", "r").alias("split"))
    )


def official_split(df: DataFrame, splits: DataFrame | None, ids: str = "ids", key: str = "path") -> DataFrame:
    """Split of rows by all the ids they involve.

    Known ids must agree, unknown ones are ignored, and rows without a known id or with
    two splits are dropped. Without an official table the sorted ids are hashed.
    """
    if splits is None:
        return df.withColumn("split", hash_split(F.array_join(F.array_sort(ids), "_")))
    agreed = (
        df.select(key, F.explode(ids).alias("id"))
        .join(splits, "id")
        .groupBy(key)
        .agg(F.min("split").alias("split"), F.max("split").alias("_other"))
        .where(F.col("split") == F.col("_other"))
        .drop("_other")
    )
    return df.join(agreed, key)


def read_test_list(spark: SparkSession, path: str) -> DataFrame:
    """File names in a ``<label> <relative path>`` list; blank lines are skipped."""
    line = F.trim(F.col("value"))
    return (
        spark.read.text(path)
        .where(line != "")
        .select(basename(F.element_at(F.split(line, r"\s+"), -1)).alias("name"))
        .distinct()
    )


def listed_test_split(df: DataFrame, test: DataFrame | None, name: str = "name", test_only: bool = False) -> DataFrame:
    """Listed files are test; others are hashed, 80/20 into train and val if a list exists."""
    if test_only:
        return df.withColumn("split", F.lit("test"))
    if test is None:
        return df.withColumn("split", hash_split("source_identity"))
    marked = df.join(test.select(F.col("name").alias(name), F.lit(True).alias("_t")), name, "left")
    rest = hash_split("source_identity", (0.8, 0.2, 0.0))
    return marked.withColumn("split", F.when(F.col("_t"), "test").otherwise(rest)).drop("_t")


def split_by_part(df: DataFrame, part: str = "part", min_parts: int = 3) -> DataFrame:
    """Last part test, the one before val, others train; identities hashed below three parts.

    Only the two last part names are looked up: a one-row aggregate, safe to broadcast.
    """
    last = df.agg(F.max(part).alias("_t"))
    names = df.select(part).distinct().crossJoin(F.broadcast(last))
    ends = names.agg(
        F.max("_t").alias("_t"),
        F.max(F.when(F.col(part) < F.col("_t"), F.col(part))).alias("_v"),
        F.count(F.lit(1)).alias("_k"),
    )
    by_part = F.when(F.col(part) == F.col("_t"), "test").when(F.col(part) == F.col("_v"), "val").otherwise("train")
    out = df.crossJoin(F.broadcast(ends))
    split = F.when(F.col("_k") >= min_parts, by_part).otherwise(hash_split("source_identity"))
    return out.withColumn("split", split).drop("_t", "_v", "_k")


# --------------------------------------------------------------------------
# layouts: listing (path) -> partial manifest
# --------------------------------------------------------------------------
PARTIAL = ["video_id", "path", "label", "dataset", "forgery_method", "split", "source_identity", "compression"]


def ffpp_manifest(listing: DataFrame, splits: DataFrame | None = None, compression: str = "c23") -> DataFrame:
    real = rf"original_sequences/youtube/{compression}/videos/[^/]+\.mp4$"
    fake = rf"manipulated_sequences/({'|'.join(FFPP_METHODS)})/{compression}/videos/[^/]+\.mp4$"
    is_real = F.col("path").rlike(real)
    method = F.when(is_real, "real").otherwise(F.regexp_extract("path", fake, 1))
    parts = F.split(stem("path"), "_")
    ids = F.when(is_real, F.array(stem("path"))).otherwise(F.slice(parts, 1, 2))
    rows = listing.where(is_real | F.col("path").rlike(fake)).select(
        F.concat_ws("_", F.lit("ffpp"), method, F.lit(compression), stem("path")).alias("video_id"),
        "path",
        F.when(is_real, 0).otherwise(1).alias("label"),
        F.lit("ffpp").alias("dataset"),
        method.alias("forgery_method"),
        F.concat(F.lit("ffpp_"), F.array_join(F.array_sort(ids), "+")).alias("source_identity"),
        F.lit(compression).alias("compression"),
        ids.alias("ids"),
    )
    return official_split(rows, splits).select(*PARTIAL)


def celebdf_manifest(listing: DataFrame, test: DataFrame | None = None, test_only: bool = False) -> DataFrame:
    folder = F.regexp_extract("path", r"(Celeb-real|YouTube-real|Celeb-synthesis)/[^/]+\.mp4$", 1)
    fake = folder == "Celeb-synthesis"
    ids = F.filter(F.split(stem("path"), "_"), lambda p: p.startswith("id"))
    who = (
        F.when(folder == "YouTube-real", F.concat(F.lit("celebdf_yt_"), stem("path")))
        .when(F.size(ids) == 0, F.concat(F.lit("celebdf_"), stem("path")))
        .otherwise(pair_key("celebdf_", ids))
    )
    rows = listing.where(folder != "").select(
        F.concat_ws("_", F.lit("celebdf"), F.lower(folder), stem("path")).alias("video_id"),
        "path",
        fake.cast("int").alias("label"),
        F.lit("celebdf").alias("dataset"),
        F.when(fake, "celebdf_synthesis").otherwise("real").alias("forgery_method"),
        who.alias("source_identity"),
        F.lit("unknown").alias("compression"),
        basename("path").alias("name"),
    )
    return listed_test_split(rows, test, test_only=test_only).select(*PARTIAL)


def read_dfdc_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """(part, file, is_fake, original) from JSON objects keyed by file name; large ones are read in parts.

    A part is the folder that its metadata lies in; of ``name=value`` folders, the value.
    """
    entry = T.StructType([T.StructField("label", T.StringType()), T.StructField("original", T.StringType())])
    folder = F.regexp_replace(F.element_at(F.split("file", "/"), -2), "^[^=]*=", "")
    return read_records(spark, pattern, entry).select(
        folder.alias("part"), F.col("key").alias("file"), (F.upper("r.label") == "FAKE").alias("is_fake"), F.col("r.original").alias("original")
    )


def dfdc_manifest(
    listing: DataFrame, meta: DataFrame, parts: Sequence[int] | None = None, by_part: bool = True
) -> DataFrame:
    """A fake inherits the identity of its original, so the two stay on one side."""
    if parts is not None:
        meta = meta.where(F.col("part").rlike(rf"(^|_)({'|'.join(str(p) for p in parts)})$"))
    files = listing.select(
        "path", F.element_at(F.split("path", "/"), -2).alias("part"), basename("path").alias("file")
    )
    fake = F.coalesce("is_fake", F.lit(False))
    source = F.when(fake & (F.coalesce("original", F.lit("")) != ""), F.col("original")).otherwise(F.col("file"))
    rows = meta.join(files, ["part", "file"]).select(
        F.concat_ws("_", F.lit("dfdc"), "part", stem("file")).alias("video_id"),
        "path",
        fake.cast("int").alias("label"),
        F.lit("dfdc").alias("dataset"),
        F.when(fake, "dfdc_unknown").otherwise("real").alias("forgery_method"),
        F.concat(F.lit("dfdc_"), stem(source)).alias("source_identity"),
        F.lit("unknown").alias("compression"),
        "part",
    )
    rows = split_by_part(rows) if by_part else rows.withColumn("split", hash_split("source_identity"))
    return rows.select(*PARTIAL)


def read_lavdf_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Records from a JSON array, or from an object whose values are the records; large ones are read in parts."""
    record = T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("filename", T.StringType()),
            T.StructField("original", T.StringType()),
            T.StructField("split", T.StringType()),
            T.StructField("modify_video", T.BooleanType()),
            T.StructField("modify_audio", T.BooleanType()),
            T.StructField("fake_periods", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    return read_records(spark, path, record).select("r.*").withColumn("file", F.coalesce(F.nullif("file", F.lit("")), "filename"))


def lavdf_manifest(listing: DataFrame, meta: DataFrame, test_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The manifest, and its (video_id, start_s, end_s) intervals as a table beside it."""
    periods = F.coalesce("fake_periods", F.array().cast("array<array<double>>"))
    rows = (
        meta.withColumns({"_p": periods, "_name": basename("file")})
        .join(listing.select("path", basename("path").alias("_name")), "_name")
        .where(F.col("path").endswith(F.col("file")))
    )
    altered = (F.size("_p") > 0) | F.coalesce("modify_video", F.lit(False)) | F.coalesce("modify_audio", F.lit(False))
    vid = F.concat(F.lit("lavdf_"), stem("file"))
    mapped = F.lit("test")
    for raw, name in LAVDF_SPLITS.items():
        mapped = F.when(F.col("split") == raw, name).otherwise(mapped)
    manifest = rows.select(
        vid.alias("video_id"),
        "path",
        altered.cast("int").alias("label"),
        F.lit("lavdf").alias("dataset"),
        lavdf_method("modify_video", "modify_audio", altered.cast("int")).alias("forgery_method"),
        (F.lit("test") if test_only else mapped).alias("split"),
        F.concat(F.lit("lavdf_"), F.coalesce(F.nullif("original", F.lit("")), stem("file"))).alias("source_identity"),
        F.lit("unknown").alias("compression"),
    )
    spans = rows.select(vid.alias("video_id"), F.explode("_p").alias("p"))
    return manifest, spans.select("video_id", F.col("p")[0].alias("start_s"), F.col("p")[1].alias("end_s"))


def deeperforensics_manifest(listing: DataFrame, test_only: bool = True) -> DataFrame:
    real = F.col("path").rlike(r"/source_videos/.*\.mp4$")
    folder = F.regexp_extract("path", r"/manipulated_videos/([^/]+)/.*\.mp4$", 1)
    parts = F.filter(F.split(stem("path"), "_"), lambda p: p != "")
    who = F.when(F.size(parts) >= 2, pair_key("dfo_", F.slice(parts, 1, 2))).otherwise(
        F.concat(F.lit("dfo_"), stem("path"))
    )
    rows = listing.where(real | (folder != "")).select(
        F.concat_ws("_", F.lit("dfo"), F.when(real, "real").otherwise(folder), stem("path")).alias("video_id"),
        "path",
        F.when(real, 0).otherwise(1).alias("label"),
        F.lit("deeperforensics").alias("dataset"),
        F.when(real, "real").otherwise(deeperforensics_tag(folder)).alias("forgery_method"),
        who.alias("source_identity"),
        F.lit("unknown").alias("compression"),
    )
    split = F.lit("test") if test_only else hash_split("source_identity")
    return rows.withColumn("split", split).select(*PARTIAL)


def fakeavceleb_manifest(listing: DataFrame, test_only: bool = True) -> DataFrame:
    combo = F.regexp_extract("path", rf"/({'|'.join(FAV_COMBOS)})/.*\.mp4$", 1)
    inner = F.split(F.regexp_extract("path", rf"/(?:{'|'.join(FAV_COMBOS)})/(.*\.mp4)$", 1), "/")
    who = F.when(F.size(inner) >= 2, F.try_element_at(inner, F.lit(-2))).otherwise(stem("path"))
    label, method = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (lab, tag) in FAV_COMBOS.items():
        label = F.when(combo == name, lab).otherwise(label)
        method = F.when(combo == name, tag).otherwise(method)
    rows = listing.where(combo != "").select(
        F.concat_ws("_", F.lit("fav"), combo, who, stem("path")).alias("video_id"),
        "path",
        label.alias("label"),
        F.lit("fakeavceleb").alias("dataset"),
        method.alias("forgery_method"),
        F.concat(F.lit("fav_"), who).alias("source_identity"),
        F.lit("unknown").alias("compression"),
    )
    split = F.lit("test") if test_only else hash_split("source_identity")
    return rows.withColumn("split", split).select(*PARTIAL)


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "ffpp": ffpp_manifest,
    "celebdf": celebdf_manifest,
    "dfdc": dfdc_manifest,
    "lavdf": lavdf_manifest,
    "deeperforensics": deeperforensics_manifest,
    "fakeavceleb": fakeavceleb_manifest,
}


def register_parser(name: str, fn: Callable[..., DataFrame]) -> None:
    PARSERS[name] = fn


def parse_dataset(name: str, *tables: DataFrame, **options):
    """Run a registered layout; unknown names are refused with the known ones listed."""
    if name not in PARSERS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(PARSERS)}")
    return PARSERS[name](*tables, **options)


def join_probes(partial: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete manifest rows, and (path, error) of those whose probe failed or is absent."""
    got = partial.join(probes.select("path", "fps", "n_frames", "duration_s", "has_audio", "sha256", "error"), "path", "left")
    error = F.coalesce("error", F.when(F.col("fps").isNull(), F.lit("ProbeError: no probe result")))
    marked = got.withColumn("error", error)
    return marked.where("error IS NULL").select(*MANIFEST.names), marked.where("error IS NOT NULL").select("path", "error")
