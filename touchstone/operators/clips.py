"""Operators over frame tables: segments, top frames, tracks, alignment, energy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import c, clip as clamp, half_up, ratio
from ..session import cut
from .ordered import order_statistic, quantiles, running_sums

CHUNK_S = 3600.0


def segments(
    frames: DataFrame,
    clip: str = "clip",
    ts: str = "ts_s",
    score: str = "score",
    thr: float = 0.5,
    merge_gap: float = 0.0,
    tie: str | None = None,
    chunk_s: float = CHUNK_S,
) -> DataFrame:
    """Runs of frames at or above ``thr``, merged over gaps of at most ``merge_gap``.

    A run ends at the next frame's time; the clip's last frame lasts one typical step
    (the upper median of positive gaps). Long clips are cut into time chunks, with the
    next frame looked up across chunks, so no clip has to fit one task.
    """
    order = [f"`{ts}`"] + ([f"`{tie}`"] if tie else [])
    base = frames.selectExpr(
        f"`{clip}` AS clip", f"CAST(`{ts}` AS DOUBLE) AS t", f"CAST(`{score}` AS DOUBLE) AS s",
        *([f"`{tie}` AS tie"] if tie else []), "1L AS one", f"`{score}` >= {thr}D AS hit",
        f"CAST(floor(`{ts}` / {chunk_s}D) AS BIGINT) AS chunk",
    )
    order = ["t"] + (["tie"] if tie else [])
    seen = running_sums(base, ["clip"], ["chunk"], order, ["one"], peek=["t", "hit"])

    gaps = seen.where("following.t > t").selectExpr("clip", "following.t - t AS gap")
    step = order_statistic(gaps, "gap", "floor(n / 2)", ["clip"], "step").select("clip", "step")

    inside = f"PARTITION BY clip, chunk ORDER BY {', '.join(order)}"
    cut = "CASE WHEN hit AND NOT coalesce(following.hit, false) THEN 1L ELSE 0L END"
    runs = (
        seen.selectExpr("*", f"sum({cut}) OVER ({inside}) - {cut} AS run")
        .where("hit")
        .groupBy("clip", "chunk", "run")
        .agg(
            F.expr("min(one_before) AS a"),
            F.expr("max(one_before) AS b"),
            F.expr("min(t) AS start"),
            F.expr("max_by(struct(t, following.t AS next), one_before) AS tail"),
            F.expr("max(struct(s, -one_before AS r, t)) AS peak"),
        )
        .join(step, "clip", "left")
        .selectExpr(
            "clip", "chunk", "a", "b", "start", "peak",
            "coalesce(tail.next, tail.t + coalesce(step, 1D)) AS end",
        )
    )
    linked = running_sums(runs.selectExpr("*", "1L AS one"), ["clip"], ["chunk"], ["a"], ["one"], peek=["a", "start"])
    linked = linked.selectExpr(
        "clip", "chunk", "a", "b", "start", "peak", "end",
        f"""CASE WHEN following IS NULL OR following.a = b + 1 OR following.start - end <= {merge_gap}D
            THEN 0L ELSE 1L END AS brk""",
    )
    marked = running_sums(linked, ["clip"], ["chunk"], ["a"], ["brk"])
    return (
        marked.groupBy("clip", "brk_before")
        .agg(
            F.expr("min(a) AS a"),
            F.expr("max(b) AS b"),
            F.expr("min(start) AS start"),
            F.expr("max_by(end, b) AS end"),
            F.expr("max(peak) AS peak"),
        )
        .select(
            F.col("clip").alias(clip),
            half_up("start", 3).alias("start_s"),
            half_up("end", 3).alias("end_s"),
            half_up("peak.s", 4).alias("peak_score"),
            half_up("peak.t", 3).alias("peak_time_s"),
            (F.col("b") - F.col("a") + 1).alias("n_frames"),
        )
    )


def top_frames(frames: DataFrame, clip: str, score: str, k: int = 3, tie: str = "ts_s") -> DataFrame:
    """The ``k`` highest frames of each clip, earlier ones first on ties.

    Partial top-k lists are cut to ``k`` before the shuffle by Spark's window group
    limit, so a long clip ships ``k`` rows per task.
    """
    w = Window.partitionBy(clip).orderBy(F.desc(score), tie)
    return frames.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def interval_hits(
    frames: DataFrame, intervals: DataFrame, clip: str = "clip", ts: str = "ts_s", bucket_s: float = 3600.0
) -> DataFrame:
    """Flag frames that lie inside any labelled interval of their clip (ends included).

    Both sides are keyed by clip and time bucket: a hash join, and a hot clip spreads
    over its buckets.
    """
    b = lambda x: F.floor(x / bucket_s).cast("bigint")
    spans = intervals.select(
        clip, "start_s", "end_s", F.explode(F.sequence(b(F.col("start_s")), b(F.col("end_s")))).alias("_b")
    )
    keyed = frames.withColumn("_b", b(F.col(ts)))
    cond = (
        (keyed[clip] == spans[clip])
        & (keyed["_b"] == spans["_b"])
        & (keyed[ts] >= spans["start_s"])
        & (keyed[ts] <= spans["end_s"])
    )
    inside = keyed.join(spans, cond, "left_semi").withColumn("inside", F.lit(True))
    outside = keyed.join(spans, cond, "left_anti").withColumn("inside", F.lit(False))
    return inside.unionByName(outside).drop("_b")


def localisation(frames: DataFrame, intervals: DataFrame, thr: float, clip: str = "clip") -> DataFrame:
    """Frame-level agreement of flagged frames with the labelled intervals, per clip."""
    hit, inside = F.col("score") >= thr, F.col("inside")
    n = lambda cond: F.count(F.when(cond, 1))
    return (
        interval_hits(frames, intervals, clip)
        .groupBy(clip)
        .agg(
            F.count(F.lit(1)).alias("n"),
            n(inside).alias("n_inside"),
            n(hit & inside).alias("tp"),
            n(hit & ~inside).alias("fp"),
            n(~hit & inside).alias("fn"),
        )
        .withColumn("iou", ratio("tp", F.col("tp") + F.col("fp") + F.col("fn")))
    )


# --------------------------------------------------------------------------
# face tracks
# --------------------------------------------------------------------------
BOX = ["seq", "x0", "y0", "x1", "y1", "conf"]


def _successors(before: str, now: str, max_jump: float) -> str:
    """SQL: for each box of the frame ``before``, the index of its box in the frame ``now``.

    That is the nearest one, or the largest where even that is more than ``max_jump`` away;
    earlier boxes win ties.
    """
    # The field names keep the lambdas of both levels apart.
    gap = "sqrt(pow((b.x0 + b.x1) / 2 - (p.x0 + p.x1) / 2, 2) + pow((b.y0 + b.y1) / 2 - (p.y0 + p.y1) / 2, 2))"
    near = f"array_min(transform({now}, (b, j) -> struct({gap} AS gap, j AS j)))"
    largest = f"-array_max(transform({now}, (b, j) -> struct((b.x1 - b.x0) * (b.y1 - b.y0) AS area, -j AS j))).j"
    chosen = f"aggregate(array({near}), CAST(0 AS INT), (s, n) -> IF(n.gap <= {max_jump!r}D, n.j, {largest}))"
    return f"transform({before}, p -> {chosen})"


def composed_prefixes(maps: DataFrame, keys: list[str], place: str, mapping: str) -> DataFrame:
    """(keys, place, mapping): each mapping after all those before it, by doubling.

    ``place`` counts 1, 2, 3 ... per key and ``mapping`` gives, for every way in, the index
    of the way out. Step j joins each row with the one 2^j places before it, so that
    log2(places) equi joins do, and no task walks a key.
    """
    done = maps.select(*keys, place, mapping)
    longest = done.agg(F.max(place)).first()[0] or 0
    reach = 1
    while reach < longest:
        done = cut(done, "prefixes")
        earlier = done.select(*keys, (F.col(place) + reach).alias(place), F.col(mapping).alias("_earlier"))
        both = F.expr(f"IF(_earlier IS NULL, `{mapping}`, transform(_earlier, s -> `{mapping}`[s]))")
        done = done.join(earlier, [*keys, place], "left").withColumn(mapping, both).drop("_earlier")
        reach *= 2
    return done


def main_track(
    boxes: DataFrame,
    clip: str = "clip",
    frame: str = "frame",
    wh: tuple[float, float] = (1280.0, 720.0),
    chunk: int = 4096,
) -> DataFrame:
    """One box per frame: follow the nearest face outward from the largest one.

    Each choice hangs on the one before it, yet a frame only maps "box held before" to
    "box held after". Clips are cut into stretches of ``chunk`` frames on either side of
    the largest face. A stretch composes its frames' maps into one, the maps of stretches
    are composed by doubling, and each stretch is then followed from its true entry. All
    of it is column expressions; no task holds more than a stretch.
    """
    max_jump = 0.25 * float(np.hypot(*wh))
    fields = ", ".join(f"'{k}', {k}" for k in BOX)
    per_frame = boxes.groupBy(clip, frame).agg(F.expr(f"sort_array(collect_list(named_struct({fields})))").alias("boxes"))
    largest = "array_max(transform(boxes, b -> struct((b.x1 - b.x0) * (b.y1 - b.y0) AS area, -b.seq AS s, b AS box)))"
    tops = per_frame.selectExpr(f"`{clip}`", f"`{frame}`", f"{largest} AS top")
    top = tops.groupBy(clip).agg(F.expr(f"max(struct(top.area, -`{frame}` AS f, top.s, top.box AS box))").alias("top"))
    anchors = top.selectExpr(f"`{clip}`", "-top.f AS anchor", "top.box AS box")

    key = [clip, "side", "chunk"]
    placed = per_frame.join(anchors, clip).selectExpr(
        f"`{clip}`", "anchor", "box", f"CAST(sign(`{frame}` - anchor) AS INT) AS side",
        f"CAST(floor(abs(`{frame}` - anchor) / {chunk}) AS BIGINT) AS chunk", f"struct(CAST(abs(`{frame}` - anchor) AS BIGINT) AS pos, boxes) AS f",
    )
    stretches = placed.where("side <> 0").groupBy(*key).agg(
        F.sort_array(F.collect_list("f")).alias("frames"), F.first("box").alias("box"), F.first("anchor").alias("anchor")
    )
    stretches = cut(stretches, "stretches")
    # Only the last frames of stretches meet in this window; their other boxes stay where they are.
    onward = Window.partitionBy(clip, "side").orderBy("chunk")
    ends = stretches.select(*key, F.expr("element_at(frames, -1).boxes").alias("_tail"))
    ends = ends.select(*key, F.lag("_tail").over(onward).alias("_before"), F.row_number().over(onward).alias("place"))
    steps = _successors("IF(i = 0, entries, frames[i - 1].boxes)", "frames[i].boxes", max_jump)
    followed = stretches.join(ends, key).withColumn("entries", F.coalesce("_before", F.array("box"))).withColumn(
        "steps", F.expr(f"transform(sequence(0, size(frames) - 1), i -> {steps})")
    )
    followed = cut(followed.drop("_before", "box", "entries"), "followed")
    whole = F.expr("aggregate(slice(steps, 2, size(steps)), steps[0], (held, m) -> transform(held, s -> m[s]))")
    exits = composed_prefixes(followed.select(clip, "side", "place", whole.alias("exits")), [clip, "side"], "place", "exits")
    entry = exits.select(clip, "side", (F.col("place") + 1).alias("place"), F.col("exits")[0].alias("entry"))

    path = """aggregate(steps, named_struct('at', coalesce(entry, 0), 'path', CAST(array() AS ARRAY<INT>)),
        (held, m) -> named_struct('at', m[held.at], 'path', array_append(held.path, m[held.at])), held -> held.path)"""
    walked = (
        followed.join(entry, [clip, "side", "place"], "left")
        .withColumn("path", F.expr(path))
        .selectExpr(f"`{clip}`", "side", "anchor", "inline(transform(path, (at, i) -> struct(frames[i].pos AS pos, frames[i].boxes[at] AS box)))")
    )
    kind = boxes.schema[frame].dataType.simpleString()
    both = walked.selectExpr(f"`{clip}`", f"CAST(anchor + side * pos AS {kind}) AS `{frame}`", "box").unionByName(
        anchors.selectExpr(f"`{clip}`", f"CAST(anchor AS {kind}) AS `{frame}`", "box")
    )
    return both.select(clip, frame, *[f"box.{k}" for k in BOX])


# --------------------------------------------------------------------------
# lip-sync offset
# --------------------------------------------------------------------------
def offset_search(
    windows: DataFrame, clip: str = "clip", w: str = "w", v: str = "v", a: str = "a", max_offset: int = 5
) -> DataFrame:
    """Best audio shift per clip and how sharp it is.

    Each offset compares only windows that overlap (never wrapping round); the search
    needs at least two. Distances are one minus the dot product of unit vectors.
    """
    size = windows.groupBy(clip).agg(F.count(F.lit(1)).alias("n_w"))
    size = size.withColumn("k", F.least(F.lit(max_offset), F.greatest(F.col("n_w") - 2, F.lit(0))).cast("int"))
    seen = windows.select(clip, F.col(w).alias("_t"), F.col(v).alias("_v")).join(size, clip)
    seen = seen.withColumn("off", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    heard = windows.select(clip, F.col(w).alias("_u"), F.col(a).alias("_a"))
    pairs = seen.join(heard, (seen[clip] == heard[clip]) & (heard["_u"] == seen["_t"] + seen["off"])).drop(heard[clip])
    dot = F.aggregate(F.zip_with("_v", "_a", lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    curves = (
        pairs.select(clip, "off", "k", "n_w", (F.lit(1.0) - dot).alias("d"))
        .groupBy(clip, "off", "k", "n_w")
        .agg(F.avg("d").alias("m"), F.count("d").alias("n"), F.expr("var_pop(d) * count(d)").alias("ss"))
    )
    # At most 2k + 1 offsets per clip, so this per-clip array stays small.
    per = curves.groupBy(clip, "k", "n_w").agg(
        F.sort_array(F.collect_list("m")).alias("ms"), F.min(F.struct("m", "off", "ss")).alias("best")
    )
    lower_median = F.element_at("ms", F.floor((F.size("ms") + 1) / 2).cast("int"))
    mean = F.aggregate("ms", F.lit(0.0), lambda s, x: s + x) / F.size("ms")
    flat = F.col("k") == 0
    return per.select(
        clip,
        F.col("best.off").alias("best_offset"),
        F.col("best.m").alias("min_dist"),
        F.when(flat, 0.0).otherwise(lower_median - F.col("best.m")).alias("conf"),
        F.when(flat, 0.0).otherwise(F.col("best.off") / F.greatest("k", F.lit(1))).alias("offset_norm"),
        mean.alias("mean_dist"),
        F.sqrt(ratio("best.ss", F.col("n_w") - 1)).alias("curve_std"),
    )


# --------------------------------------------------------------------------
# audio energy
# --------------------------------------------------------------------------
def energy_snr(
    samples: DataFrame, by: Sequence[str], sr: int, index: str = "i", amplitude: str = "y"
) -> DataFrame:
    """Speech-presence proxy in [0, 1]: how far loud windows stand above quiet ones.

    Energies are window means, so a long track shuffles one row per window.
    """
    win = max(sr // 50, 1)
    n = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"))
    energies = (
        samples.groupBy(*by, F.floor(F.col(index) / win).alias("win"))
        .agg(F.avg(c(amplitude) * c(amplitude)).alias("e"), F.count(F.lit(1)).alias("k"))
        .where(F.col("k") == win)
    )
    q = quantiles(energies, "e", {"hi": 0.9, "lo": 0.1}, by)
    whole = F.floor(F.col("n_samples") / win)
    db = F.log10((F.col("hi") + 1e-12) / (F.col("lo") + 1e-12)) * 10.0
    usable = (F.col("n_samples") >= sr // 10) & (whole >= 4) & (F.col("hi") > 1e-12)
    return (
        n.join(q, list(by), "left")
        .withColumn("snr", F.when(usable, clamp(db / 40.0, 0.0, 1.0)).otherwise(0.0))
        .select(*by, "snr")
    )
