"""Exact running sums over a whole table, without sorting it in one task.

A window without ``partitionBy`` (or with one hot key) pulls every row into one task.
Here the order is cut into *levels*: columns that sort the same way as the full order,
coarse to fine. Totals are taken per level, each level is summed along its siblings
only, and offsets are handed down. Every window then sees one bucket, whatever the
size of the group, and nothing is sampled, so results are exact and repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction

#: Score buckets per unit of log odds, and hash buckets per group. A group then has a
#: few million score buckets at most, and a bucket holds about a hundred of the values
#: that a 32-bit score can take.
SCORE_BUCKETS = 65536
HASH_BUCKETS = 65536
ALL = "_all"


def spread(x: str) -> str:
    """A non-decreasing map of any double that spaces detector scores evenly, as SQL.

    Scores crowd near 0 and 1, where equal-width buckets would be badly filled; log
    odds spread them. Values outside (0, 1) go to log scales on either side. Spark's
    logarithms are semi-monotonic, so the order of buckets never contradicts the order
    of scores; order inside a bucket is by the score itself.
    """
    return f"""(CASE WHEN {x} <= 0 THEN -800D - log1p(-{x}) WHEN {x} >= 1 THEN 40D + ln({x})
        ELSE ln({x}) - log1p(-{x}) END)"""


def score_level(x: str, descending: bool) -> str:
    """A bucket expression that sorts like the double ``x`` (or against it)."""
    return f"floor({'-' if descending else ''}{spread(x)} * {SCORE_BUCKETS}D)"


def hash_level(u: str) -> str:
    """A bucket expression for orders that go by a hash fraction."""
    return f"CAST(floor({u} * {HASH_BUCKETS}D) AS INT)"


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give an ungrouped table a constant key, so that one code path serves both."""
    if by:
        return df, list(by)
    return df.withColumn(ALL, F.lit(1)), [ALL]


def gone(by: Sequence[str]) -> list[str]:
    """The constant key, where ``keyed`` added one."""
    return [] if by else [ALL]


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    peek: Sequence[str] = (),
) -> DataFrame:
    """Add ``<v>_before`` (sum over earlier rows) and ``<v>_total`` for each value.

    ``by`` must be non-empty (see ``keyed``); rows with a null key take no part. ``levels`` and ``order`` are SQL
    expressions, all ascending; levels agree with the order, which settles rows inside
    the finest bucket. The next row's ``peek`` columns come along as the struct
    ``following`` (null at the end of a group).
    """
    by = list(by)
    names = [f"_l{i}" for i in range(len(levels))]
    kept = df.columns
    tick = lambda cols: ", ".join(f"`{k}`" for k in cols)
    # Keys that are known not to be null give both sides of the joins below the same
    # plan up to their first shuffle, so that it runs once and is reused.
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    df = df.selectExpr("*", *[f"coalesce({lv}, 0) AS {n}" for lv, n in zip(levels, names)])

    head = f"struct({tick(peek)})"
    sums = [F.expr(f"sum(`{v}`) AS `{v}`") for v in values]
    first = [F.expr(f"min_by({head}, struct({', '.join(order)})) AS _head")] if peek else []
    tables = [df.groupBy(*by, *names).agg(*sums, *first)]
    for depth in range(len(names) - 1, 0, -1):
        up = [F.expr(f"min_by(_head, {names[depth]}) AS _head")] if peek else []
        tables.insert(0, tables[0].groupBy(*by, *names[:depth]).agg(*sums, *up))

    offsets = None
    for depth, table in enumerate(tables):
        part = f"PARTITION BY {tick(by + names[:depth])}"
        sofar = f"OVER ({part} ORDER BY {names[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        follow = f"lead(_head) OVER ({part} ORDER BY {names[depth]})"
        if offsets is None:
            exprs = [f"coalesce(sum(`{v}`) {sofar}, 0) AS `_o_{v}`" for v in values]
            exprs += [f"sum(`{v}`) OVER ({part}) AS `{v}_total`" for v in values]
        else:
            table = table.join(offsets, by + names[:depth])
            exprs = [f"`_o_{v}` + coalesce(sum(`{v}`) {sofar}, 0) AS `_o_{v}`" for v in values]
            exprs += [f"`{v}_total`" for v in values]
            follow = f"coalesce({follow}, _after)"
        if peek:
            exprs.append(f"{follow} AS _after")
        offsets = table.selectExpr(*[f"`{k}`" for k in by], *names[: depth + 1], *exprs)

    part = f"PARTITION BY {tick(by + names)} ORDER BY {', '.join(order)}"
    sofar = f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    added = [f"`{v}_total`" for v in values]
    added += [f"`_o_{v}` + coalesce(sum(`{v}`) {sofar}, 0) AS `{v}_before`" for v in values]
    if peek:
        added.append(f"coalesce(lead({head}) OVER ({part}), _after) AS following")
    return df.join(offsets, by + names).selectExpr(*[f"`{k}`" for k in kept], *added)


def hash_rank(df: DataFrame, by: Sequence[str], key: Column, row_id: str, name: str = "rank") -> DataFrame:
    """1-based rank of rows per group in order of ``hash_fraction(key)``, then id.

    A pseudo-random order that any engine reproduces, ranked bucket by bucket.
    """
    df, keys = keyed(df, by)
    df = df.withColumns({"_u": hash_fraction(key), "_one": F.lit(1).cast("bigint")})
    out = running_sums(df, keys, [hash_level("_u")], ["_u", f"`{row_id}`"], ["_one"])
    return (
        out.withColumns({name: F.col("_one_before") + 1, f"{name}_of": F.col("_one_total")})
        .drop("_u", "_one", "_one_before", "_one_total", *gone(by))
    )


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name in ``probs``.

    Ranks come from counts per distinct value, so no task ever holds a whole group.
    """
    data, keys = keyed(df, by)
    counts = (
        data.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_sums(counts, keys, [score_level("_x", descending=False)], ["_x"], ["_n"])
    aggs = []
    for name, p in probs.items():
        pos = f"({p}D * (_n_total - 1))"
        lo = f"max(CASE WHEN floor({pos}) >= _n_before AND floor({pos}) < _n_before + _n THEN _x END)"
        hi = f"max(CASE WHEN ceil({pos}) >= _n_before AND ceil({pos}) < _n_before + _n THEN _x END)"
        part = f"max({pos} - floor({pos}))"
        aggs.append(F.expr(f"{lo} + ({hi} - {lo}) * {part}").alias(name))
    return ranked.groupBy(*keys).agg(*aggs).drop(*gone(by))


def order_statistic(df: DataFrame, value: str, index: str, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """The row at a 0-based rank per group; ``index`` is SQL over ``n``, the group's size."""
    data, keys = keyed(df, by)
    counts = (
        data.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_sums(counts, keys, [score_level("_x", descending=False)], ["_x"], ["_n"])
    ranked = ranked.withColumnRenamed("_n_total", "n")
    here = F.expr(f"({index}) >= _n_before AND ({index}) < _n_before + _n")
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(here, F.col("_x"))).alias(name)).drop(*gone(by))
