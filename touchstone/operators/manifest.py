"""Manifest checks: row rules, duplicate keys, summaries and the leakage audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction
from ..functions.numeric import half_up
from ..schemas import COMPRESSIONS, DATASETS, MANIFEST, SPLITS, require_columns
from .ordered import hash_level, keyed, quantiles, running_sums, score_level

# --------------------------------------------------------------------------
# row rules
# --------------------------------------------------------------------------
def manifest_rules() -> dict[str, Column]:
    """Message -> condition that marks a bad row. Null fields count as bad."""
    method, label = F.trim("forgery_method"), F.col("label")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return {
        "video_id: empty": bad(F.length("video_id") >= 1),
        "path: empty": bad(F.length("path") >= 1),
        "label: not 0 or 1": bad(label.isin(0, 1)),
        "dataset: unknown": bad(F.col("dataset").isin(DATASETS)),
        "split: unknown": bad(F.col("split").isin(SPLITS)),
        "has_audio: missing": F.col("has_audio").isNull(),
        "source_identity: empty": bad(F.length("source_identity") >= 1),
        "compression: unknown": bad(F.col("compression").isin(COMPRESSIONS)),
        "fps: not positive": bad(F.col("fps") > 0),
        "n_frames: not positive": bad(F.col("n_frames") > 0),
        "duration_s: not positive": bad(F.col("duration_s") > 0),
        "sha256: not 64 long": bad(F.length("sha256") == 64),
        "label 0 needs method 'real'": F.coalesce((label == 0) & (method != "real"), F.lit(False)),
        "label 1 needs a named method": F.coalesce((label == 1) & (method == "real"), F.lit(False)),
    }


def validate(df: DataFrame, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and bad ones, the latter with every broken rule listed."""
    if rules is None:
        df = require_columns(df, MANIFEST.names, "manifest").withColumn("forgery_method", F.trim("forgery_method"))
        rules = manifest_rules()
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for msg, cond in rules.items()]))
    marked = df.withColumn("errors", errors)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def duplicate_keys(df: DataFrame, key: str = "video_id") -> DataFrame:
    """Keys that occur more than once, with the number of surplus rows."""
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


class ManifestError(ValueError):
    """A manifest that must not be used: bad rows, duplicate ids or leakage."""


def require_valid(df: DataFrame) -> DataFrame:
    """The checked manifest, or an error showing the first 20 problems and the count."""
    good, bad = validate(df)
    n = bad.count()
    if n:
        shown = [f"{r['video_id']}: {', '.join(r['errors'])}" for r in bad.orderBy("video_id").limit(20).collect()]
        raise ManifestError(f"{n} invalid rows; first {len(shown)}:\n" + "\n".join(shown))
    dup = duplicate_keys(df)
    n = dup.count()
    if n:
        shown = [r["video_id"] for r in dup.orderBy("video_id").limit(20).collect()]
        raise ManifestError(f"{n} duplicate video_id values; first {len(shown)}: {shown}")
    return good


def concat_manifests(*dfs: DataFrame) -> DataFrame:
    """All rows of several manifests, checked again as one."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return require_valid(out)


# --------------------------------------------------------------------------
# summaries
# --------------------------------------------------------------------------
def summarise(m: DataFrame) -> DataFrame:
    """Counts per dataset and split, and per forgery method within a dataset."""
    per_split = m.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("label") == 0, 1)).alias("n_real"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_fake"),
        F.count(F.when(F.col("has_audio"), 1)).alias("n_audio"),
        F.countDistinct("source_identity").alias("n_identities"),
    )
    return per_split


def totals(m: DataFrame) -> DataFrame:
    """One row: clips and datasets of a whole manifest."""
    return m.agg(F.count(F.lit(1)).alias("videos"), F.countDistinct("dataset").alias("datasets"))


def method_counts(m: DataFrame) -> DataFrame:
    return m.where("label = 1").groupBy("forgery_method").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "forgery_method"
    )


def audio_evidence(m: DataFrame) -> DataFrame:
    """Share of clips with sound per dataset, and how serious a gap is."""
    pct = half_up(100.0 * F.col("with_audio") / F.col("n"), 1)
    t = m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has_audio"), 1)).alias("with_audio"))
    return t.withColumn("pct", pct).withColumn(
        "severity", F.when(F.col("with_audio") == 0, "info").when(F.col("pct") < 100, "warn")
    )


def skew(m: DataFrame) -> DataFrame:
    """Class balance, method balance, duration and frame-rate shape per dataset."""
    base = m.groupBy("dataset").agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("n_real"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_fake"),
        F.countDistinct("source_identity").alias("n_identities"),
    )
    methods = m.where("label = 1").groupBy("dataset", "forgery_method").agg(F.count(F.lit(1)).alias("k"))
    uneven = methods.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_methods"), F.max("k").alias("most"), F.min("k").alias("least")
    )
    dur = quantiles(m, "duration_s", {"duration_median": 0.5, "duration_p05": 0.05, "duration_p95": 0.95}, ["dataset"])
    fps = quantiles(m, "fps", {"fps_median": 0.5}, ["dataset"])
    per_real = F.col("n_fake") / F.greatest("n_real", F.lit(1))
    return (
        base.join(uneven, "dataset", "left")
        .join(dur, "dataset", "left")
        .join(fps, "dataset", "left")
        .select(
            "dataset",
            "n_real",
            "n_fake",
            half_up(per_real, 2).alias("fake_per_real"),
            "n_identities",
            F.coalesce("n_methods", F.lit(0)).alias("n_methods"),
            *[half_up(k, 1).alias(k) for k in ("duration_median", "duration_p05", "duration_p95", "fps_median")],
            F.when(per_real > 3, "warn").alias("balance_severity"),
            F.when((F.col("n_methods") > 1) & (F.col("most") / F.greatest("least", F.lit(1)) > 2), "info").alias(
                "method_severity"
            ),
        )
    )


def missing_splits(m: DataFrame, min_rows: int = 20) -> DataFrame:
    """Datasets of more than ``min_rows`` rows that lack a split."""
    t = m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.collect_set("split").alias("present"))
    missing = F.array_sort(F.array_except(F.lit(SPLITS), "present"))
    return t.where(F.col("n") > min_rows).select("dataset", "n", missing.alias("missing")).where(F.size("missing") > 0)


# --------------------------------------------------------------------------
# leakage
# --------------------------------------------------------------------------
def identity_overlap(m: DataFrame) -> DataFrame:
    """Identities seen on both sides of a split boundary, one row per pair of splits."""
    seen = m.groupBy("dataset", "source_identity").agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = F.flatten(
        F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    return (
        seen.where(F.size("s") > 1)
        .select("dataset", "source_identity", F.explode(pairs).alias("p"))
        .select("dataset", F.concat_ws("|", "p.a", "p.b").alias("pair"), "source_identity")
    )


def label_conflicts(m: DataFrame) -> DataFrame:
    """Ids with two labels, and rows whose label and method disagree."""
    two = m.groupBy("video_id").agg(F.countDistinct("label").alias("k")).where("k > 1")
    odd = m.where("(label = 0 AND forgery_method <> 'real') OR (label = 1 AND forgery_method = 'real')")
    return (
        two.select("video_id", F.lit("conflicting labels").alias("problem"))
        .unionByName(odd.select("video_id", F.lit("label and method disagree").alias("problem")))
        .distinct()
    )


def missing_files(m: DataFrame, listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Manifest paths that the listing lacks, or the first ``limit`` of them."""
    gone = m.select("path").join(listing.select("path"), "path", "left_anti")
    return gone if limit is None else gone.orderBy("path").limit(limit)


def leak_report(m: DataFrame, classes: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """One row of counts; ``ok`` needs all of them zero but the cross-dataset one.

    ``classes`` is the output of ``duplicates.classify``.
    """
    spark = m.sparkSession
    one = spark.range(1).select()
    overlap = identity_overlap(m).agg(F.count(F.lit(1)).alias("identity_overlaps"))
    conflict = label_conflicts(m).agg(F.countDistinct("video_id").alias("label_conflicts"))
    if classes is None:
        dup = one.select(F.lit(0).cast("bigint").alias("split_duplicates"), F.lit(0).cast("bigint").alias("cross_dataset_duplicates"))
    else:
        n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n_pairs"))), F.lit(0))
        dup = classes.agg(n("split").alias("split_duplicates"), n("dataset").alias("cross_dataset_duplicates"))
    if listing is None:
        gone = one.select(F.lit(0).cast("bigint").alias("missing_files"))
    else:
        gone = missing_files(m, listing, None).agg(F.count(F.lit(1)).alias("missing_files"))
    row = overlap.crossJoin(conflict).crossJoin(dup).crossJoin(gone)
    total = F.col("identity_overlaps") + F.col("label_conflicts") + F.col("split_duplicates") + F.col("missing_files")
    return row.withColumn("ok", total == 0)


def assert_clean(m: DataFrame, **kw) -> DataFrame:
    """The leak report, or an error if it is not ok."""
    report = leak_report(m, **kw)
    row = report.first()
    if not row["ok"]:
        raise ManifestError(f"manifest leaks: {row.asDict()}")
    return report


# --------------------------------------------------------------------------
# cache state
# --------------------------------------------------------------------------
def cache_todo(m: DataFrame, cache: DataFrame, version: int, overwrite: bool = False) -> DataFrame:
    """Clips whose cached entry is absent, outdated or without a face."""
    if overwrite:
        return m
    ready = cache.where((F.col("version") == version) & (F.col("n_faces") >= 1))
    return m.join(ready.select("dataset", "video_id"), ["dataset", "video_id"], "left_anti")


def cache_coverage(m: DataFrame, cache: DataFrame, version: int, listing: DataFrame | None = None) -> DataFrame:
    """Cached share of each dataset's whole manifest; fine above 95 %."""
    ready = cache.where((F.col("version") == version) & (F.col("n_faces") >= 1)).select(
        "dataset", "video_id", F.lit(1).alias("_c")
    )
    t = m.join(ready, ["dataset", "video_id"], "left")
    if listing is not None:
        t = t.join(listing.select("path", F.lit(1).alias("_p")), "path", "left")
    else:
        t = t.withColumn("_p", F.lit(1))
    return t.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_c").alias("cached"),
        (F.count(F.lit(1)) - F.count("_p")).alias("missing_paths"),
    ).select("*", (F.col("cached") / F.col("n") > 0.95).alias("ok"))


# --------------------------------------------------------------------------
# derived manifests
# --------------------------------------------------------------------------
# Lossy transforms of existing media, and the tags some of them carry.
RECIPES = [
    "crf40", "double_encode", "low_bitrate", "letterbox", "offcentre_crop", "downscale_240p", "hflip", "fps_15",
    "fps_60_interp", "audio_strip", "audio_opus_low", "audio_music_bed", "audio_swap",
]
RECIPE_TAGS = ["crf23", "crf32", "crf40"]


def partner_paths(m: DataFrame) -> DataFrame:
    """Each clip's partner: the next clip's path, the last one's being the first.

    A table has no row order, so clips are ordered by hashed id, which fills the rank
    buckets evenly however the ids look. A single clip has no partner.
    """
    base = m.select("video_id", "path", hash_fraction("video_id").alias("u"), F.lit(1).alias("one"))
    base, keys = keyed(base, [])
    ranked = running_sums(base, keys, [hash_level("u")], ["u", "video_id"], ["one"], peek=["path"])
    first = m.agg(F.min_by("path", F.struct(hash_fraction("video_id"), "video_id")).alias("first_path"))
    return (
        ranked.where("one_total >= 2")
        .crossJoin(F.broadcast(first))
        .selectExpr("video_id", "path", "coalesce(following.path, first_path) AS partner")
    )


def degrade_manifest(m: DataFrame, recipes: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """One derived row per clip and recipe, always in the test split.

    ``done`` lists (video_id, recipe, path) of transforms that worked; the rest are
    dropped. Without it recipes are a literal array, and no join spreads them; with it
    clips meet its rows by id, so only ``done`` is as long as the result. No side of that
    join is broadcast: size estimates do not know how many rows an explode makes.
    """
    recipes = list(dict.fromkeys(recipes))
    if done is None:
        out = m.withColumn("recipe", F.explode(F.lit(recipes)))
    else:
        made = done.where(F.col("recipe").isin(recipes)).select("video_id", "recipe", "path")
        out = m.drop("path").join(made.hint("merge"), "video_id")
    return out.select(
        F.concat_ws("__", "video_id", "recipe").alias("video_id"),
        "path",
        "label",
        "dataset",
        "forgery_method",
        F.lit("test").alias("split"),
        (F.col("has_audio") & (F.col("recipe") != "audio_strip")).alias("has_audio"),
        "source_identity",
        F.when(F.col("recipe").isin(RECIPE_TAGS), F.col("recipe")).otherwise("unknown").alias("compression"),
        "fps",
        "n_frames",
        "duration_s",
        "sha256",
    )


def domain_ids(df: DataFrame, key: str, seq: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(value, id) numbered in first-seen order; known values keep their ids.

    Pass the table returned for earlier batches as ``vocabulary``.
    """
    seen = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.min(seq).cast("double").alias("_f"))
    if vocabulary is not None:
        seen = seen.join(vocabulary.select("value"), "value", "left_anti")
    seen, keys = keyed(seen.withColumn("one", F.lit(1)), [])
    ranked = running_sums(seen, keys, [score_level("_f", descending=False)], ["_f", "value"], ["one"])
    if vocabulary is None:
        return ranked.selectExpr("value", "one_before AS id")
    size = vocabulary.agg(F.count(F.lit(1)).alias("_k"))
    new = ranked.crossJoin(F.broadcast(size)).selectExpr("value", "one_before + _k AS id")
    return vocabulary.select("value", "id").unionByName(new)
