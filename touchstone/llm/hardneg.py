"""Hard negatives of anchors, with scores bounded along spanning trees of the anchors.

A row's score is its integer inner product with an anchor. By Cauchy and Schwarz, the
scores that a candidate c has at two anchors differ by no more than their distance times
the norm of c. The anchors of one label are therefore joined in minimum spanning trees. On
the way from parent to child, the interval of a candidate's score grows by the edge's
length times its norm; only where the interval meets the window that the child asks for
is the score computed, and then the interval is that score alone. Windows are exact: for
positives, all from the worst kept score up; for negatives, the shares of the positives'
scores that are asked for, less what the kept ones have shut out.

Anchors are a stated query set. They are worked off in panels of bounded size; a panel is
sent to all tasks, which pass over the candidates without moving them and return the best
of each anchor. No pair of rows is joined, and no step holds more than a panel.

Odd rows: rows without vec_id or label, and those whose vector is null, empty or holds null
or non-finite components, take no part; nor do vectors of another length than the first
anchor's by vec_id. Rows that repeat an anchor's vec_id are not its partners. Repeated rows of other
ids count each; equal anchors are one. Ties go to the smaller vec_id. An empty table, or
one without anchors, gives no rows. Integers beyond 2^27 are cut off there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import new_path

SCALE = 256
#: Anchors of a tree, and of a panel, on average.
TREE, PANEL = 1024, 8192
#: Candidates that a task takes through the trees at once.
ROWS = 2048
#: Integers up to this size keep inner products within 64 bits.
LARGEST = 1 << 27

TREES = "panel int, label long, part long, vec_id long, v array<long>, at int, parent int, edge double"
POSITIVES = "anchor int, score long, vec_id long"
NEGATIVES = "anchor int, place int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    plain = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.size("embedding") > 0).where(plain)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: rows so that parents come first, parents as places in that order."""
    n = len(v)
    x = v.astype(np.float64)
    far, near, free = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    order, place, parent, edge = np.zeros(n, int), np.zeros(n, int), np.full(n, -1), np.zeros(n)
    row = 0
    for k in range(n):
        order[k], place[row], free[row] = row, k, False
        if k:
            parent[k], edge[k] = place[near[row]], far[row]
        step = np.sqrt(((x - x[row]) ** 2).sum(1))
        closer = free & (step < far)
        far[closer], near[closer] = step[closer], row
        row = int(np.argmin(np.where(free, far, np.inf)))
    return order, parent, edge


def trees(rows: DataFrame, anchors: Column, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(stored trees of all anchors, number of panels). A label with many anchors has several trees, dealt by hash."""
    spark = rows.sparkSession
    own = rows.where(anchors).distinct()
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    panels = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // PANEL))
    dealt = own.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / TREE)))
    dealt = dealt.withColumn("panel", F.pmod(F.xxhash64("label", "part"), F.lit(panels)).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        v = integers(np.stack(pdf["embedding"].to_numpy()), scale)
        order, parent, edge = spanning_tree(v)
        out = pdf.iloc[order][["panel", "label", "part", "vec_id"]]
        return out.assign(v=list(v[order]), at=np.arange(len(v), dtype=np.int32), parent=parent.astype(np.int32), edge=edge)

    path = new_path(spark, "anchor-trees")
    found = dealt.groupBy("label", "part").applyInPandas(build, TREES)
    found.write.partitionBy("panel").parquet(path)
    return spark.read.schema(TREES).parquet(path), panels


@dataclass
class Tree:
    """Anchors of one label in an order that puts parents first, with places in their panel."""

    label: int
    first: int
    ids: np.ndarray
    v: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    children: np.ndarray = field(init=False)

    def __post_init__(self):
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        self.norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))

    def walk(self, x: np.ndarray, norm: np.ndarray, low, high) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's place in the tree, rows of ``x``, their scores): all rows with a score within low..high, and few others.

        ``low`` and ``high`` give an anchor's window when its turn comes. Rows whose
        interval misses the window are not scored; their interval goes on to the children.
        """
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * x.shape[1] < 2**53
        xs, vs = (x.astype(np.float64), self.v.astype(np.float64)) if exact else (x, self.v)
        bounds, left = {}, self.children.copy()
        for k, p in enumerate(self.parent):
            if p < 0:
                reach = norm * self.norm[k] * (1 + 1e-9) + 1
                lo, hi = -reach, reach
            else:
                reach = norm * (self.edge[k] * (1 + 1e-9)) + 1
                lo, hi = bounds[p][0] - reach, bounds[p][1] + reach
                left[p] -= 1
                if not left[p]:
                    del bounds[p]
            at = np.flatnonzero((hi >= low(k)) & (lo <= high(k)))
            if len(at) > len(x) // 2:
                score = (xs @ vs[k])[at]
            else:
                score = xs[at] @ vs[k]
            if left[k]:
                lo[at] = hi[at] = score
                bounds[k] = (lo, hi)
            yield k, at, score.astype(np.int64)


class Best:
    """The best ``k`` scores of one list, with their ids; ``least`` is what a further score must reach."""

    __slots__ = ("ids", "k", "least", "scores")

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def _batches(batches, scale: int):
    """(vec_id, label, integers, norms) of the candidates, ROWS at a time."""
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            part = b.slice(a, ROWS)
            x = integers(part.column("embedding").flatten().to_numpy(zero_copy_only=False), scale).reshape(part.num_rows, -1)
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x, np.sqrt((x.astype(np.float64) ** 2).sum(1))


def forest(panel: pd.DataFrame) -> list[Tree]:
    """Trees of a panel; an anchor's place is its tree's first place and its own within the tree."""
    out, first = [], 0
    for (label, _), t in panel.groupby(["label", "part"], sort=True):
        t = t.sort_values("at")
        out.append(Tree(label, first, t["vec_id"].to_numpy(), np.stack(t["v"].to_numpy()), t["parent"].to_numpy(), t["edge"].to_numpy()))
        first += len(t)
    return out


def _positives(grown: list[Tree], k: int, scale: int):
    """A task's best ``k`` rows of the same label for each anchor of the panel."""

    def run(batches):
        best = [Best(k, -(1 << 62)) for t in grown for _ in t.ids]
        for ids, labels, x, norm in _batches(batches, scale):
            for t in grown:
                own = np.flatnonzero(labels == t.label)
                if not len(own):
                    continue
                lists = best[t.first : t.first + len(t.ids)]
                for j, at, score in t.walk(x[own], norm[own], lambda j, lists=lists: lists[j].least, lambda _: np.inf):
                    other = ids[own[at]]
                    good = np.flatnonzero((score >= lists[j].least) & (other != t.ids[j]))
                    if len(good):
                        lists[j].add(score[good], other[good])
        anchors = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.ids) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(anchors), *[_column(best, c) for c in ("scores", "ids")]], ["anchor", "score", "vec_id"])

    return run


def _column(best: list[Best], name: str) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *[getattr(b, name) for b in best]]))


def _negatives(grown: list[Tree], asked: dict[int, list[tuple[int, int]]], k: int, low: int, scale: int):
    """A task's best ``k`` rows of another label for each anchor and positive of the panel.

    ``asked``: (positive's id, its score) of an anchor's place, best first.
    """

    def run(batches):
        lists = {a: [Best(k, -(-low * s // 100)) for _, s in own] for a, own in asked.items()}
        # Of a positive below 0, no score is both below it and above a share of it.
        least = lambda a: min((b.least for b, (_, s) in zip(lists[a], asked[a]) if s >= 0), default=np.inf) if a in lists else np.inf
        most = {a: own[0][1] for a, own in asked.items()}
        for ids, labels, x, norm in _batches(batches, scale):
            for t in grown:
                other = np.flatnonzero(labels != t.label)
                if not len(other):
                    continue
                window = (lambda j, f=t.first: least(f + j)), (lambda j, f=t.first: most.get(f + j, -np.inf))
                for j, at, score in t.walk(x[other], norm[other], *window):
                    a = t.first + j
                    at, score = at[in_window := (score <= most.get(a, -np.inf)) & (score >= least(a))], score[in_window]
                    at = at[apart := ids[other[at]] != t.ids[j]]
                    score = score[apart]
                    if len(at):
                        for b, (_, s) in zip(lists[a], asked[a]):
                            good = np.flatnonzero((score >= b.least) & (score <= s))
                            if s >= 0 and len(good):
                                b.add(score[good], ids[other[at[good]]])
        flat = [(a, i, *asked[a][i], b) for a, own in lists.items() for i, b in enumerate(own)]
        names = {a: t.ids[a - t.first] for t in grown for a in range(t.first, t.first + len(t.ids))}
        n = [len(f[4].ids) for f in flat]
        repeated = lambda values, kind=np.int64: pa.array(np.repeat(np.array(values, kind), n))
        columns = [
            repeated([f[0] for f in flat], np.int32), repeated([f[1] for f in flat], np.int32), repeated([names[f[0]] for f in flat]),
            repeated([f[2] for f in flat]), repeated([f[3] for f in flat]), _column([f[4] for f in flat], "ids"), _column([f[4] for f in flat], "scores"),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NEGATIVES.split(", ")])

    return run


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of each key, with their ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row of ``vectors`` where ``anchors`` holds, and each of its best ``positives``
    rows of the same label, the best ``negatives`` rows of another label whose score is
    between ``low`` percent of the positive's and the positive's itself.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = rows.where(anchors).orderBy("vec_id", "embedding").select(F.size("embedding").alias("width")).limit(1).collect()
    rows = rows.where(F.size("embedding") == (first[0][0] if first else 0))
    planted, panels = trees(rows, anchors, scale)
    paths = []
    for panel in range(panels):
        grown = forest(planted.where(F.col("panel") == panel).toPandas())
        found = rows.mapInArrow(_positives(grown, positives, scale), POSITIVES)
        asked: dict[int, list] = {}
        for r in _top(found, ["anchor"], positives).orderBy("anchor", "rank").collect():  # at most PANEL x positives rows
            asked.setdefault(r["anchor"], []).append((r["vec_id"], r["score"]))
        paths.append(new_path(spark, "hard-negatives"))
        missed = rows.mapInArrow(_negatives(grown, asked, negatives, low, scale), NEGATIVES)
        _top(missed, ["anchor", "place"], negatives).write.parquet(paths[-1])
    return spark.read.parquet(*paths).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
