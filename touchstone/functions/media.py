"""Rules on uploads and probes: policy, container magic, probe repair, config flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import c, half_up

# Upload limits, codecs and container magic.
MAX_DURATION_S, MAX_UPLOAD_MB, MIN_SIDE = 60.0, 100, 64
CODECS = ["h264", "hevc", "vp8", "vp9", "av1", "mpeg4", "mjpeg", "theora"]
MAGIC = [(4, b"ftyp"), (0, b"\x1a\x45\xdf\xa3"), (0, b"RIFF"), (0, b"FLV")]


def sniff(head) -> Column:
    """Whether the first bytes carry a known container's magic."""
    h = c(head)
    ok = F.lit(False)
    for offset, magic in MAGIC:
        ok = ok | (F.substring(h, offset + 1, len(magic)) == F.lit(bytearray(magic)))
    return ok


def upload_policy(df: DataFrame, head: str | None = None) -> DataFrame:
    """Reason for refusing an upload, or null; the first rule broken decides.

    Size is checked while streaming in, so it comes before container, decoding and
    content rules. Undecodable uploads are those without a duration.
    """
    reason = F.when(F.col("size_bytes") > MAX_UPLOAD_MB * 1024 * 1024, "too_large")
    if head:
        reason = reason.when(F.col("size_bytes") == 0, "other").when(~sniff(head), "bad_container")
    reason = (
        reason.when(F.col("duration_s").isNull(), "undecodable")
        .when(F.col("duration_s") > MAX_DURATION_S, "too_long")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "other")
        .when(F.least("width", "height") < MIN_SIDE, "other")
        .when(~F.col("codec").isin(CODECS), "other")
    )
    return df.withColumn("reason", reason)


PROBE = T.StructType(
    [
        T.StructField("avg_frame_rate", T.StringType()),
        T.StructField("r_frame_rate", T.StringType()),
        T.StructField("duration", T.StringType()),
        T.StructField("format_duration", T.StringType()),
        T.StructField("nb_frames", T.StringType()),
        T.StructField("audio_channels", T.StringType()),
        T.StructField("audio_duration", T.StringType()),
    ]
)


def repair_probe(df: DataFrame, probe: str = "probe", keep: str = "path") -> DataFrame:
    """Frame rate, frame count, duration and sound from a probe's JSON, gaps filled in.

    The first usable ``num/den`` rate wins, else 25. A missing count follows from
    duration and rate, a missing duration from count and rate.
    """
    num = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))

    def rate(k: str) -> Column:
        parts = F.split(F.col(f"p.{k}"), "/")
        a, b = num(F.get(parts, F.lit(0))), num(F.get(parts, F.lit(1)))
        return F.when((a > 0) & (b > 0) & (F.size(parts) == 2), F.try_divide(a, b))

    one = df.select(keep, F.from_json(probe, PROBE).alias("p")).select(
        keep,
        F.coalesce(rate("avg_frame_rate"), rate("r_frame_rate"), F.lit(25.0)).alias("fps"),
        F.coalesce(F.nullif(num(F.col("p.format_duration")), F.lit(0.0)), num(F.col("p.duration"))).alias("d"),
        num(F.col("p.nb_frames")).cast("bigint").alias("n"),
        num(F.col("p.audio_channels")).alias("ch"),
        F.nullif(num(F.col("p.audio_duration")), F.lit(0.0)).alias("ad"),
    )
    two = one.withColumn(
        "n_frames", F.when(F.col("n") > 0, F.col("n")).otherwise(F.greatest(F.floor(F.col("d") * F.col("fps")), F.lit(1)))
    )
    dur = F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("n_frames") / F.col("fps"))
    return two.select(
        keep,
        half_up("fps", 4).alias("fps"),
        "n_frames",
        half_up(dur, 3).alias("duration_s"),
        ((F.col("ch") > 0) & (F.coalesce("ad", dur) > 0.05)).alias("has_audio"),
    )


def flatten_config(df: DataFrame, column: str) -> DataFrame:
    """One column per leaf of a struct, dotted names; arrays become comma lists.

    Works on the schema alone, so it costs a projection.
    """
    out = []

    def walk(field: Column, typ: T.DataType, name: str) -> None:
        if isinstance(typ, T.StructType):
            for f in typ:
                walk(field[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(typ, T.ArrayType):
            out.append(F.array_join(F.transform(field, lambda x: x.cast("string")), ",").alias(name))
        else:
            out.append(field.alias(name))

    walk(F.col(column), df.schema[column].dataType, "")
    return df.select(*[k for k in df.columns if k != column], *out)


# Who may read test material.
TEST_READERS = ["a5_paper", "a6_defence", "human"]
READABLE_SPLITS = ["train", "val"]


def read_policy(requests: DataFrame, source_dataset: str | None = None) -> DataFrame:
    """Reasons why a read request (agent, path, split, dataset) is refused."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("split").isin(READABLE_SPLITS), F.lit("split not readable")),
            F.when(F.contains(name, F.lit("test")), F.lit("looks like a test artefact")),
            F.when(F.col("dataset") != F.lit(source_dataset), F.lit("target domain")),
        )
    )
    privileged = F.col("agent").isin(TEST_READERS)
    return requests.withColumn("reasons", F.when(privileged, F.array().cast("array<string>")).otherwise(reasons))


def readable(df: DataFrame, agent: str, split: str = "split") -> DataFrame:
    """Only the rows an agent may see: a guard to put on any table with a split."""
    return df if agent in TEST_READERS else df.where(F.col(split).isin(READABLE_SPLITS))
