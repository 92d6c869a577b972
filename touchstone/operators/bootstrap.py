"""Bootstrap of ROC metrics on counts, not on rows.

Rows that share a group, a score and a label are one *cell*. Resampling n rows of a cell
by Poisson(1) weights gives it a Poisson(n) weight, so one draw per cell and replicate
replaces one per row, and cells shrink map-side before anything is drawn. Draws hang on a
hash of the cell's smallest row id and on the replicate's number alone: they do not depend
on partitions, on retries or on the engine.

The AUC of all replicates is one ordered fold. Cells are range-partitioned by score; a
task folds its part of a group into a tally whose entries are arrays over replicates, and
tallies of neighbouring parts merge associatively. What is shuffled grows with the
number of cells and partitions, never with rows times replicates. Other metrics need a
whole curve: they see the cells of a group, a block of replicates at a time. Groups with
too many cells for that take the built-in metrics through the score table instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from math import exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a group that one task may hold, and tasks among which its replicates are dealt.
CELLS, BLOCKS = 2_000_000, 8
#: Cells that are drawn at once, and tallies that are merged by one task.
STEP, FAN = 1024, 128
#: Up to this count, edges start at zero; beyond, they cover the part that 32 bits resolve.
PLAIN = 400
GOLDEN, MIX = 0x9E3779B9, (0x85EBCA6B, 0xC2B2AE35)


# --------------------------------------------------------------------------
# draws
# --------------------------------------------------------------------------
@lru_cache(maxsize=4096)
def poisson_edges(n: int) -> tuple[int, np.ndarray]:
    """(first value, cumulative probabilities from it on) of Poisson(n)."""
    if n <= PLAIN:
        total, term, edges = 0.0, exp(-float(n)), []
        k = 0
        while total < 1 - 1e-12 and k < 10 * PLAIN:
            total += term
            edges.append(round(total, 12))
            k += 1
            term *= n / k
        return 0, np.array(edges)
    wide = int(12 * sqrt(n)) + 20
    first = max(0, n - wide)
    k = np.arange(first, n + wide + 1)
    middle = n * log(n) - n - lgamma(n + 1)
    up = np.concatenate([[0.0], np.cumsum(log(n) - np.log(np.arange(n + 1, n + wide + 1)))])
    down = np.cumsum(np.log(np.arange(n, first, -1)) - log(n))[::-1]
    p = np.exp(middle + np.concatenate([down, up]))
    assert len(p) == len(k)
    return first, np.cumsum(p)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(MIX[0])
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def draws(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(n) weights (cells, replicates) from the 64 hash bits of each cell."""
    number = (replicates.astype(np.uint64) * GOLDEN & 0xFFFFFFFF).astype(np.uint32)
    u = _mix(_mix(hi.astype(np.uint32)[:, None] ^ number) ^ lo.astype(np.uint32)[:, None]) / float(2**32)
    out = np.empty(u.shape)
    for count in np.unique(n):
        first, edges = poisson_edges(int(count))
        at = np.flatnonzero(n == count)
        out[at] = first + np.searchsorted(edges, u[at], "right")
    return out


def cells_of(df: DataFrame, keys: Sequence[str], label: str, scores: Sequence[str], row_id: str, seed: int = 0) -> DataFrame:
    """(keys, scores, y, n, hi, lo): counts of equal rows, and 64 bits that their draws hang on."""
    usable = F.col(label).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    for s in scores:
        usable = usable & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    own = [F.col(s).cast("double").alias(s) for s in scores]
    counts = df.where(usable).groupBy(*keys, *own, (F.col(label) == 1).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(row_id).cast("string")).alias("_id")
    )
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit(""))), 256)
    word = lambda at: F.conv(F.substring("_d", at, 8), 16, 10).cast("bigint")
    return counts.withColumn("_d", digest).withColumns({"hi": word(1), "lo": word(9)}).drop("_id", "_d")


# --------------------------------------------------------------------------
# AUC: an ordered fold
# --------------------------------------------------------------------------
#: Arrays over replicates: positives, negatives, pairs in order (ties half), and the
#: positives and negatives at the first and at the last score, for ties with neighbours.
ARRAYS = ("p", "n", "u", "p_first", "n_first", "p_last", "n_last")


def tally(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """The tally of cells that go from the highest score down."""
    starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    n = np.add.reduceat(w, starts, axis=0)
    p = np.add.reduceat(w * y[:, None], starts, axis=0)
    n -= p
    above = np.cumsum(p, axis=0) - p
    return {
        "first": score[0], "last": score[-1], "p": p.sum(0), "n": n.sum(0), "u": (n * (above + p / 2)).sum(0),
        "p_first": p[0], "n_first": n[0], "p_last": p[-1], "n_last": n[-1],
    }


def merge(a: dict | None, b: dict) -> dict:
    """The tally of ``a`` followed by ``b``; a score may end one and begin the other."""
    if a is None:
        return b
    tie = a["last"] == b["first"]
    out = {"first": a["first"], "last": b["last"], "p": a["p"] + b["p"], "n": a["n"] + b["n"], "u": a["u"] + b["u"] + b["n"] * a["p"]}
    if tie:
        out["u"] = out["u"] + (a["n_last"] * b["p_first"] - b["n_first"] * a["p_last"]) / 2
    for k in ("p", "n"):
        out[f"{k}_first"] = a[f"{k}_first"] + (b[f"{k}_first"] if tie and a["first"] == a["last"] else 0)
        out[f"{k}_last"] = b[f"{k}_last"] + (a[f"{k}_last"] if tie and b["first"] == b["last"] else 0)
    return out


def _row(found: dict) -> list:
    return [found["first"], found["last"], *[list(found[k]) for k in ARRAYS]]


def _tallies(keys: list[str], score: str, n_boot: int):
    """Per partition of sorted cells, one tally of each group that it holds a part of."""

    def run(batches):
        from pyspark import TaskContext

        part, now, so_far, rows = TaskContext.get().partitionId(), None, None, []
        replicates = np.arange(n_boot)

        def close():
            rows.append([*now, part, *_row(so_far)])

        for b in batches:
            values = [b.column(k).to_pylist() for k in keys]
            s, y, n, hi, lo = (b.column(c).to_numpy(zero_copy_only=False) for c in (score, "y", "n", "hi", "lo"))
            owners = list(zip(*values))
            cuts = [0, *[i for i in range(1, len(owners)) if owners[i] != owners[i - 1]], len(owners)]
            for a, z in zip(cuts, cuts[1:]):
                if now is not None and owners[a] != now:
                    close()
                    so_far = None
                now = owners[a]
                for at in range(a, z, STEP):
                    i = slice(at, min(at + STEP, z))
                    so_far = merge(so_far, tally(s[i], y[i].astype(float), draws(hi[i], lo[i], n[i], replicates)))
        if now is not None:
            close()
        schema = [b.schema.field(k) for k in keys] if rows else []
        if rows:
            kinds = [*[f.type for f in schema], pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * len(ARRAYS)]
            names = [*keys, "part", "first", "last", *ARRAYS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _merged(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for r in pdf.sort_values("part").to_dict("records"):
            out = merge(out, r | {k: np.asarray(r[k]) for k in ARRAYS})
        return pd.DataFrame([[*pdf.iloc[0][keys], pdf["part"].min(), *_row(out)]], columns=[*keys, "part", "first", "last", *ARRAYS])

    return run


def auc_replicates(cells: DataFrame, keys: Sequence[str], score: str, n_boot: int) -> DataFrame:
    """(keys, replicate, auc); null where a replicate has one class."""
    keys = list(keys)
    order = [*keys, F.desc(score), "hi", "lo", "y"]
    placed = cells.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, score, "y", "n", "hi", "lo")
    schema = T.StructType([cells.schema[k] for k in keys]).add("part", "long").add("first", "double").add("last", "double")
    for name in ARRAYS:
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    parts = placed.mapInArrow(_tallies(keys, score, n_boot), schema)
    few = parts.groupBy(*keys, F.floor(F.col("part") / FAN).alias("_fan")).applyInPandas(_merged(keys), schema)
    one = few.groupBy(*keys).applyInPandas(_merged(keys), schema)
    value = F.transform(F.arrays_zip("u", "p", "n"), lambda t: F.try_divide(t["u"], t["p"] * t["n"]))
    return one.select(*keys, F.posexplode(value).alias("replicate", "auc"))


# --------------------------------------------------------------------------
# other metrics: a curve per replicate
# --------------------------------------------------------------------------
def _curve(score, pos, neg):
    """(tpr, fpr, corner) after each score, from the highest down; None with one class."""
    p, n = pos.sum(), neg.sum()
    if not p or not n:
        return None
    corner = np.ones(len(score), bool)
    corner[1:-1] = (pos[2:] != pos[1:-1]) | (neg[2:] != neg[1:-1])
    return np.cumsum(pos) / p, np.cumsum(neg) / n, corner


def cell_auc(score, pos, neg):
    p, n = pos.sum(), neg.sum()
    return (neg * (np.cumsum(pos) - pos / 2)).sum() / (p * n) if p and n else None


def cell_ap(score, pos, neg):
    p = pos.sum()
    tps = np.cumsum(pos)
    return (pos / p * tps / (tps + np.cumsum(neg))).sum() if p and neg.sum() else None


def cell_eer(score, pos, neg):
    curve = _curve(score, pos, neg)
    if curve is None:
        return None
    tpr, fpr, corner = curve
    gap = np.abs((1 - tpr) - fpr)[corner]
    if gap.min() >= 1:
        return 0.5
    at = np.flatnonzero(corner)[np.argmin(gap)]
    return (fpr[at] + (1 - tpr[at])) / 2


def cell_partial_auc(max_fpr: float) -> Callable:
    def metric(score, pos, neg):
        curve = _curve(score, pos, neg)
        if curve is None:
            return None
        tpr, fpr = (np.concatenate([[0.0], x]) for x in curve[:2])
        inside = np.minimum(fpr, max_fpr)
        step = fpr[1:] - fpr[:-1]
        top = tpr[:-1] + (tpr[1:] - tpr[:-1]) * np.divide(inside[1:] - fpr[:-1], step, out=np.ones_like(step), where=step > 0)
        keep = fpr[:-1] < max_fpr
        area = ((inside[1:] - fpr[:-1]) * (tpr[:-1] + top) / 2)[keep].sum()
        least = 0.5 * max_fpr**2
        return 0.5 * (1 + (area - least) / (max_fpr - least))

    return metric


def cell_tpr_at_fpr(target: float) -> Callable:
    def metric(score, pos, neg):
        curve = _curve(score, pos, neg)
        if curve is None:
            return None
        tpr, fpr = (np.concatenate([[0.0], x]) for x in curve[:2])
        at = np.searchsorted(fpr, target, "right") - 1
        if at + 1 == len(fpr):
            return tpr[at]
        return tpr[at] + (tpr[at + 1] - tpr[at]) / (fpr[at + 1] - fpr[at]) * (target - fpr[at])

    return metric


#: On (score, positives, negatives) of one replicate, from the highest score down.
CELL_METRICS: dict[str, Callable] = {
    "auc": cell_auc,
    "ap": cell_ap,
    "eer": cell_eer,
    "pauc10": cell_partial_auc(0.1),
    "tpr_at_1fpr": cell_tpr_at_fpr(0.01),
    "tpr_at_5fpr": cell_tpr_at_fpr(0.05),
    "tpr_at_10fpr": cell_tpr_at_fpr(0.10),
}


def of_rows(fn: Callable) -> Callable:
    """A metric of cells from one of rows, ``fn(y, s)``: each row comes as often as it was drawn."""

    def metric(score, pos, neg):
        pos, neg = pos.astype(np.int64), neg.astype(np.int64)
        if not pos.sum() or not neg.sum():
            return None
        y = np.repeat(np.tile([1, 0], len(score)), np.column_stack([pos, neg]).ravel())
        return fn(y, np.repeat(score, pos + neg))

    return metric


def cell_replicates(cells: DataFrame, keys: Sequence[str], score: str, metrics: dict[str, Callable], n_boot: int) -> DataFrame:
    """(keys, replicate, one column per metric); replicate -1 has the counts as they are.

    A task holds the cells of one group and goes through its share of the replicates in
    small blocks. Values that are not finite become null.
    """
    keys, names = list(keys), list(metrics)
    share = max(1, -(-n_boot // BLOCKS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, "hi", "lo"], ascending=[False, True, True])
        s, y, n = pdf[score].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        block, out = int(pdf["_block"].iloc[0]), []
        numbers = np.array([-1]) if block < 0 else np.arange(block * share, min((block + 1) * share, n_boot))
        at_once = max(1, 4_000_000 // len(s))
        for a in range(0, len(numbers), at_once):
            some = numbers[a : a + at_once]
            w = n[:, None].astype(float) if block < 0 else draws(pdf["hi"].to_numpy(), pdf["lo"].to_numpy(), n, some)
            pos = np.add.reduceat(w * (y == 1)[:, None], starts, axis=0)
            neg = np.add.reduceat(w, starts, axis=0) - pos
            for j, r in enumerate(some):
                drawn = (pos[:, j] + neg[:, j]) > 0
                values = [f(s[starts][drawn], pos[drawn, j], neg[drawn, j]) for f in metrics.values()] if drawn.any() else [None] * len(names)
                out.append([r, *[None if v is None or not np.isfinite(v) else float(v) for v in values]])
        found = pd.DataFrame(out, columns=["replicate", *names])
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "replicate", *names]]

    schema = T.StructType([cells.schema[k] for k in keys]).add("replicate", "integer")
    for m in names:
        schema = schema.add(m, "double")
    last = (n_boot - 1) // share
    dealt = cells.withColumn("_block", F.explode(F.sequence(F.lit(-1), F.lit(last))))
    return dealt.groupBy(*keys, "_block").applyInPandas(run, schema)


@F.pandas_udf(T.LongType())
def drawn_weight(hi: pd.Series, lo: pd.Series, n: pd.Series, replicate: pd.Series) -> pd.Series:
    """The same draws, one cell and replicate a row."""
    out = np.zeros(len(hi), np.int64)
    numbers = replicate.to_numpy()
    for r in np.unique(numbers):
        at = np.flatnonzero(numbers == r)
        out[at] = draws(hi.to_numpy()[at], lo.to_numpy()[at], n.to_numpy()[at], np.array([r]))[:, 0]
    return pd.Series(out)


def exploded(cells: DataFrame, n_boot: int) -> DataFrame:
    """Every cell once per replicate, with its weight ``_w``: for groups too large to be held."""
    rows = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    return rows.withColumn("_w", drawn_weight("hi", "lo", "n", "replicate")).where("_w > 0")
