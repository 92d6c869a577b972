"""Near-duplicate clips by positional 64-bit frame signatures.

Two clips match when at least ``min_frames`` positions differ by at most ``threshold``
bits. Exact copies are folded into one *class* first, so a flood of copies costs one
row. Within a position, so are equal signatures; distinct ones within ``threshold`` bits
agree on one of ``threshold + 1`` bands, which finds the links between them. Bands that
agree by chance end there: what classes carry on as keys are links (two close
signatures, or one that several classes have), not bands.

A match shares keys at ``min_frames`` positions. Its rarest shared key therefore has, in
either class, ``min_frames - 1`` other positions with a key that is less rare. Keys
without that many are left out: a frame that all clips have in common, or two of them,
bring no pair together. Keys that are still shared by very many classes are split by a
second position's key, which every true match must share as well. Nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HOT_KEY = 500


def _band(h: str, i: str, bands: int) -> str:
    """Band ``i`` of a 64-bit signature: its bits from ``64*i/bands`` on, as SQL."""
    lo, hi = f"CAST(64 * {i} / {bands} AS INT)", f"CAST(64 * ({i} + 1) / {bands} AS INT)"
    return f"(shiftrightunsigned({h}, {lo}) & (shiftleft(1L, {hi} - {lo}) - 1L))"


def classes(hashes: DataFrame, block_bits: int = 0) -> DataFrame:
    """One row per distinct signature list: a representative id, the list, its size.

    With ``block_bits``, only classes whose first signatures share that many leading bits
    are compared, which trades matches for speed.
    """
    block = f"shiftrightunsigned(phash[0], {64 - block_bits})" if block_bits else "0L"
    return (
        hashes.where(F.size("phash") > 0)
        .groupBy("phash")
        .agg(F.min("video_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .select("rep", "phash", "n", F.expr(block).alias("block"))
    )


def members(hashes: DataFrame) -> DataFrame:
    """Every clip with its class representative."""
    reps = hashes.where(F.size("phash") > 0).groupBy("phash").agg(F.min("video_id").alias("rep"))
    return hashes.join(reps, "phash").select("rep", "video_id")


def rarest_first(keys: DataFrame, min_frames: int) -> DataFrame:
    """Keys that can be the rarest of ``min_frames`` shared ones: a prefix filter over positions.

    Keys have one order, by the number ``m`` of classes that share them. A key stays if
    ``min_frames - 1`` other positions of its class have a later one; the latest keys of
    ``min_frames`` positions tell that.
    """
    if min_frames < 2:
        return keys
    order = "struct(m, p, i, v)"
    latest = keys.groupBy("rep", "p").agg(F.expr(f"max({order})").alias("o"))
    tops = latest.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("o"), asc=False), 1, min_frames).alias("tops"))
    others = f"filter(tops, o -> o.p <> p)[{min_frames - 2}]"
    return cut(keys.join(tops, "rep").where(f"size(tops) >= {min_frames} AND {others} > {order}").drop("tops"), "keys")


def signature_links(at: DataFrame, threshold: int) -> DataFrame:
    """(block, p, i, v, h, m): links of signatures at a position, one row per end ``h``.

    A link is a pair ``i < v`` of different signatures within the threshold, or one
    signature of several classes (``i = v``); ``m`` is the number of classes it touches.
    Bands only bring signatures together here; rows are distinct signatures of two
    numbers, and what leaves the join is close.
    """
    bands = threshold + 1
    sigs = cut(at.groupBy("block", "p", "h").agg(F.count(F.lit(1)).alias("k")), "signatures")
    each = f"transform(sequence(0, {bands - 1}), j -> struct(j, {_band('h', 'j', bands)} AS w))"
    keys = sigs.selectExpr("block", "p", "h", "k", f"inline({each})")
    on = " AND ".join(f"a.{k} = b.{k}" for k in ("block", "p", "j", "w"))
    met = keys.alias("a").hint("merge").join(keys.alias("b"), F.expr(f"{on} AND a.h < b.h AND bit_count(a.h ^ b.h) <= {threshold}"))
    pairs = met.selectExpr("a.block", "a.p", "a.h AS i", "b.h AS v", "a.k + b.k AS m").distinct()
    ends = pairs.selectExpr("block", "p", "i", "v", "m", "explode(array(i, v)) AS h")
    return ends.unionByName(sigs.where("k > 1").selectExpr("block", "p", "h AS i", "h AS v", "k AS m", "h"))


def class_links(
    cls: DataFrame, threshold: int = 6, min_frames: int = 3, hot_key: int = HOT_KEY
) -> DataFrame:
    """Pairs of classes that match, each once, with their truncated mean distance."""
    cls = cut(cls.where(F.size("phash") >= min_frames), "classes")
    at = cls.select("rep", "block", F.posexplode("phash").alias("p", "h"))
    on = ["block", "p", "i", "v"]
    counted = cut(at.join(signature_links(at, threshold).hint("merge"), ["block", "p", "h"]), "keys")
    keys = rarest_first(counted, min_frames)

    # At a link of two signatures, classes meet across it; those on one side have a link of their own.
    across = " AND ".join([*[f"a.{k} = b.{k}" for k in on], "a.rep < b.rep", "(a.i = a.v OR a.h <> b.h)"])

    def pairs(side: DataFrame, more: str = "") -> DataFrame:
        met = side.alias("a").hint("merge").join(side.alias("b"), F.expr(across + more))
        return met.selectExpr("a.rep AS rep_a", "b.rep AS rep_b")

    # Rows of this join hold one signature; whole lists are attached to distinct pairs only.
    splits = min_frames >= 2
    found = pairs(keys.where(F.col("m") <= hot_key) if splits else keys)
    if splits:
        # Of the keys that a match shares, the first one brings it here and the others come later.
        second = counted.selectExpr("rep", "m AS n", "p AS q", "i AS x", "v AS y", "h AS g")
        later = "q <> p AND struct(n, q, x, y) > struct(m, p, i, v)"
        hot = keys.where(F.col("m") > hot_key).join(second.hint("merge"), "rep").where(later)
        found = found.union(pairs(hot, " AND a.q = b.q AND a.x = b.x AND a.y = b.y AND (a.x = a.y OR a.g <> b.g)"))
    one = cls.select(F.col("rep").alias("rep_a"), F.col("phash").alias("ha"), F.col("n").alias("n_a"))
    two = cls.select(F.col("rep").alias("rep_b"), F.col("phash").alias("hb"), F.col("n").alias("n_b"))
    found = found.distinct().join(one.hint("merge"), "rep_a").join(two.hint("merge"), "rep_b")
    dist = "filter(zip_with(ha, hb, (x, y) -> bit_count(x ^ y)), d -> d <= {t})".format(t=threshold)
    return (
        found.selectExpr("rep_a", "rep_b", "n_a", "n_b", f"{dist} AS ds")
        .where(F.size("ds") >= min_frames)
        .selectExpr(
            "rep_a", "rep_b", "n_a", "n_b", "size(ds) AS n_frames",
            "CAST(floor(aggregate(ds, 0L, (s, d) -> s + d) / size(ds)) AS INT) AS distance",
        )
    )


def near_duplicates(
    hashes: DataFrame, threshold: int = 6, min_frames: int = 3, hot_key: int = HOT_KEY
) -> DataFrame:
    """Every match, as links between classes: (rep_a, rep_b, n_a, n_b, n_frames, distance).

    A link stands for all ``n_a * n_b`` pairs of its members (see ``members``), which
    share one distance since copies have equal signatures. A class of several copies
    links to itself at distance 0, standing for its ``n * (n - 1) / 2`` pairs.
    """
    cls = classes(hashes)
    own = cls.where((F.size("phash") >= min_frames) & (F.col("n") > 1)).selectExpr(
        "rep AS rep_a", "rep AS rep_b", "n AS n_a", "n AS n_b", "size(phash) AS n_frames", "0 AS distance"
    )
    return class_links(cls, threshold, min_frames, hot_key).unionByName(own)


def classify(hashes: DataFrame, manifest: DataFrame, threshold: int = 6, min_frames: int = 3) -> DataFrame:
    """Counts of matching pairs per link and place: ``split`` fails, ``dataset`` warns.

    Pairs are counted from how each class spreads over (dataset, split), never listed,
    so copies cost nothing extra.
    """
    cls = classes(hashes)
    mix = (
        members(hashes)
        .join(manifest.select("video_id", "dataset", "split"), "video_id", "left")
        .groupBy("rep", "dataset", "split")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    a, b = mix.alias("a"), mix.alias("b")
    links = class_links(cls, threshold, min_frames)
    place = "a.dataset AS dataset_a, a.split AS split_a, b.dataset AS dataset_b, b.split AS split_b".split(", ")
    across = (
        links.join(a, F.expr("a.rep = rep_a"))
        .join(b, F.expr("b.rep = rep_b"))
        .selectExpr("rep_a", "rep_b", *place, "distance", "a.k * b.k AS n_pairs")
    )
    enough = cls.where(F.size("phash") >= min_frames).select("rep")
    own = mix.join(enough, "rep", "left_semi")
    within = (
        own.alias("a")
        .join(own.alias("b"), F.expr("a.rep = b.rep AND struct(a.dataset, a.split) < struct(b.dataset, b.split)"))
        .selectExpr("a.rep AS rep_a", "b.rep AS rep_b", *place, "0 AS distance", "a.k * b.k AS n_pairs")
    )
    kind = F.when((F.col("dataset_a") == F.col("dataset_b")) & (F.col("split_a") != F.col("split_b")), "split").when(
        F.col("dataset_a") != F.col("dataset_b"), "dataset"
    )
    return across.unionByName(within).withColumn("kind", kind).where(F.col("kind").isNotNull())
