"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share all words by weight; a source stops at ``most`` times its size and
the excess goes to the others by weight. Each source is a shuffled stream of documents,
cut into blocks of equal tokens and read in passes. Slot i of the schedule is the golden
ratio point frac(i * phi); the source whose cumulative share holds the point gets the
slot, and the slot's rank within the source names pass and block. Sources therefore
alternate evenly at every scale, without drawing random numbers.

Everything is DataFrame operations: the order of documents is a range partitioning, ranks
are counts per stretch of slots, and points meet sources on equal cells of the unit
interval, so neither a hot source nor many sources end in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .order import numbered, ordered, sums_before

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 256
MOST = 3
PHI = 0.6180339887498949
#: Cells of the unit interval, and slots that are ranked together.
CELLS, STRETCH = 4096, 65536


@dataclass
class Mix:
    """``documents``: one row per row of the input; ``schedule``: one row per slot."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def sized(docs: DataFrame) -> DataFrame:
    """Words of each whole text; a null text has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sources: DataFrame, weights=(5, 2, 1), most: int = MOST) -> DataFrame:
    """Add ``sid``, ``weight``, ``target`` and the words before the source, to (source, source_size).

    Sources go by code point, null last; weights repeat. A source at its limit keeps it;
    the others share the rest by weight: with sources in order of limit per weight, the
    first that the common rate does not fill gives the rate for all that follow.
    """
    first = F.when(F.col("source").isNull(), 1).otherwise(0)
    w = cut(numbered(sources.withColumn("_last", first), ["_last", "source"], "sid").drop("_last"), "sources")
    table = F.array(*[F.lit(float(x)) for x in weights])
    w = w.withColumn("weight", table[(F.col("sid") % len(weights)).cast("int")]).withColumn("limit", F.col("source_size") * most)
    by_rate = cut(ordered(w.withColumn("rate", F.col("limit") / F.col("weight")), ["rate", "sid"]), "rates")
    totals = by_rate.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).collect()[0]
    if not totals["all"]:
        rate = 0.0
    else:
        common = (F.lit(totals["all"]) - F.col("limit_before")) / (F.lit(totals["w"]) - F.col("weight_before"))
        open_ = sums_before(by_rate, ["limit", "weight"]).withColumn("common", common).where("common <= rate")
        rate = open_.agg(F.min_by("common", F.struct("rate", "sid")).alias("c")).collect()[0]["c"]
    w = w.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(float(rate))))
    # Words of the sources before this one.
    placed = cut(ordered(w, ["sid"]), "sources")
    return cut(sums_before(placed, ["source_size"]).drop("at", "limit"), "targets")


def slots(sources: DataFrame, block: int) -> DataFrame:
    """The schedule: slot, sid, pass, block, and the words that the slot takes."""
    spark = sources.sparkSession
    quota = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    s = sources.select("sid", "source_size", quota.alias("quota"), F.ceil(F.col("source_size") / block).alias("blocks"), full.alias("passes"))
    s = s.withColumn("need", F.expr(f"passes * blocks + ceil((quota - passes * source_size) / {block})")).where("need > 0")
    s = cut(sums_before(cut(ordered(s, ["sid"]), "needs"), ["need"]).drop("at"), "needs")
    n = s.agg(F.sum("need").alias("n")).collect()[0]["n"] or 0
    share = lambda c: f"CAST(floor({c} * {float(CELLS)}D / {max(1, n)}D) AS INT)"
    cells = s.selectExpr("sid", "need_before AS lo", "need_before + need AS hi", f"explode(sequence({share('need_before')}, {share('(need_before + need)')})) AS cell")
    at = F.expr(f"(id + 1) * {PHI}D - floor((id + 1) * {PHI}D)") * F.lit(float(n))
    points = spark.range(n).select(F.col("id").alias("slot"), at.alias("x")).withColumn("cell", F.expr(share("x")))
    drawn = points.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "sid")
    drawn = cut(drawn.withColumn("stretch", F.floor(F.col("slot") / STRETCH)), "slots")
    earlier = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("sid", "stretch").agg(F.count("*").alias("c"))
    before = counts.select("sid", "stretch", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("sid", "stretch").orderBy("slot")
    ranked = drawn.join(before, ["sid", "stretch"]).select("slot", "sid", (F.col("before") + F.row_number().over(here) - 1).alias("rank"))
    # Points fall a few short of, or beyond, a source's need: the surplus goes unused, and
    # what is missing follows at the end.
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    short = s.join(got, "sid", "left").where("coalesce(got, 0) < need").selectExpr("sid", "explode(sequence(coalesce(got, 0), need - 1)) AS rank")
    late = short.select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    return (
        ranked.union(late).join(s.drop("need_before"), "sid").where("rank < need")
        .selectExpr("slot", "sid", "CAST(rank div blocks AS INT) AS pass", "rank % blocks AS block", "source_size", "quota")
        .withColumn("take", F.expr(f"least({block}, source_size - block * {block}, quota - pass * source_size - block * {block})"))
        .where("take > 0").drop("source_size", "quota")
    )


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = MOST, block: int = BLOCK_TOKENS) -> Mix:
    """Plan the mix of ``docs`` (text, doc_id, source and any other columns, which are kept).

    Adds ``size``, ``source_size``, ``target`` and ``taken`` (words of the row that the mix
    takes over all passes). Rows without words take none, null sources are one source, and
    an empty table gives an empty plan. The sum of ``taken`` of a source is its rounded
    target, and no row exceeds ``most`` times its size. Columns that clash with those it adds
    or works with (sid, at, start, *_before) are dropped.
    """
    docs = sized(docs.drop("size", "source_size", "target", "taken", "sid", "at", "start", "size_before", "source_size_before"))
    rest = [k for k in docs.columns if k not in ("text", "source", "size")]
    rows = cut(docs.select(*rest, "source", "size"), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(by_source, weights, most)
    known = rows.withColumn("_s", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    named = sources.select(
        F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_s"), "sid", "source_size", "target", "source_size_before"
    )
    known = known.join(named, "_s").drop("_s").withColumn("_h", F.xxhash64("doc_id"))
    placed = cut(ordered(known, ["sid", "_h", "doc_id", "size"]).drop("_h"), "shuffled")
    placed = sums_before(placed, ["size"]).withColumn("start", F.col("size_before") - F.col("source_size_before"))
    placed = cut(placed.drop("size_before", "source_size_before"), "placed")
    schedule = cut(slots(sources, block), "schedule")

    pieces = placed.where("size > 0").selectExpr(
        "at", "sid", "start", "size", f"explode(sequence(start div {block}, (start + size - 1) div {block})) AS block"
    )
    part = f"greatest(0, least(start + size, block * {block} + take) - greatest(start, block * {block}))"
    taken = pieces.join(schedule, ["sid", "block"]).groupBy("at").agg(F.sum(F.expr(part)).alias("taken"))
    documents = placed.join(taken, "at", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return Mix(documents.drop("at", "start", "sid"), schedule, sources)
