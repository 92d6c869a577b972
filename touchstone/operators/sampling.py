"""Deterministic training samples: balanced by class and method, and audio-stratified batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import hash_rank


def _salted(seed: int, epoch: int, row_id: str):
    return F.concat(F.lit(f"{seed}:{epoch}:"), F.col(row_id).cast("string"))


def balanced_sample(df: DataFrame, n: int, seed: int = 0, epoch: int = 0, row_id: str = "video_id") -> DataFrame:
    """``n`` draws, half real, half fake with equal shares per method.

    Draws go round a stratum in hashed order: a quota below the stratum's size takes
    distinct rows, one above repeats them evenly. With a class missing, the whole table
    is one stratum. The column ``draw`` numbers the draws of a stratum.
    """
    sizes = df.agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("_reals"),
        F.countDistinct(F.when(F.col("label") == 1, F.col("forgery_method"))).alias("_methods"),
    )
    # One row of two counts: a bounded broadcast.
    data = df.crossJoin(F.broadcast(sizes))
    both = (F.col("_reals") > 0) & (F.col("_methods") > 0)
    stratum = F.when(~both, "all").when(F.col("label") == 0, "real").otherwise(F.concat(F.lit("fake:"), "forgery_method"))
    half = n // 2
    quota = (
        F.when(~both, n)
        .when(F.col("label") == 0, half)
        .otherwise(F.greatest(F.floor(F.lit(half) / F.greatest("_methods", F.lit(1))), F.lit(1)))
    )
    data = data.withColumns({"stratum": stratum, "_q": quota.cast("bigint")}).drop("_reals", "_methods")
    ranked = hash_rank(data, ["stratum"], _salted(seed, epoch, row_id), row_id, "_r")
    full, rest = F.floor(F.col("_q") / F.col("_r_of")), F.col("_q") % F.col("_r_of")
    # With replacement: only where the quota exceeds the stratum, rows come again.
    copies = full + F.when(F.col("_r") <= rest, 1).otherwise(0)
    return (
        ranked.where(copies > 0)
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), (copies - 1).cast("bigint"))))
        .withColumn("draw", F.col("_c") * F.col("_r_of") + F.col("_r"))
        .drop("_q", "_r", "_r_of", "_c")
    )


def stratified_batches(
    df: DataFrame, batch_size: int, min_frac: float = 0.25, seed: int = 0, epoch: int = 0, row_id: str = "video_id"
) -> DataFrame:
    """Batches that each hold ``max(int(batch_size * min_frac), 1)`` rows with sound.

    Both pools are dealt out in hashed order, going round again when one runs short;
    rows of the pool with more than its share of places are left over, as whole batches
    of ``n div batch_size`` demand. With one pool empty, the other fills the batches, and
    the last one takes what remains.
    """
    k = max(int(batch_size * min_frac), 1)
    sizes = df.agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("has_audio"), 1)).alias("_a")
    ).withColumn("_one_pool", (F.col("_a") == 0) | (F.col("_a") == F.col("_n")))
    data = df.crossJoin(F.broadcast(sizes))
    pool = F.when(F.col("_one_pool"), "all").when(F.col("has_audio"), "audio").otherwise("silent")
    share = F.when(F.col("_one_pool"), batch_size).when(F.col("has_audio"), k).otherwise(batch_size - k)
    data = data.withColumns({"pool": pool, "_share": share, "_nb": F.when(F.col("_one_pool"), F.ceil(F.col("_n") / batch_size)).otherwise(F.floor(F.col("_n") / batch_size))})
    ranked = hash_rank(data, ["pool"], _salted(seed, epoch, row_id), row_id, "_r")
    # Where both pools exist, places of a short pool are filled by going round it again.
    places = F.when(F.col("_one_pool"), F.col("_n")).otherwise(F.col("_nb") * F.col("_share"))
    times = F.floor((places - F.col("_r")) / F.col("_r_of"))
    return (
        ranked.where(F.col("_r") <= places)
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint"))))
        .withColumn("batch", F.floor((F.col("_c") * F.col("_r_of") + F.col("_r") - 1) / F.col("_share")))
        .select(*[x for x in df.columns], "pool", "batch")
    )
