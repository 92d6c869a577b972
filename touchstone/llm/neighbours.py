"""Approximate nearest neighbours: an NN-descent graph, and greedy search on it.

The graph joins every distinct vector with its K best others by inner product. It starts
from random-projection leaves and improves by joins of neighbours of neighbours, each
round a Spark job over the whole graph, until few edges change. A search starts at a
vector's own neighbours and expands the nearest vectors until its whole beam is expanded.

In the graph, inner products become distances by one more coordinate, sqrt(M^2 - |x|^2)
with the largest norm M. A query has 0 there, so that a search ranks by the inner product
itself, and it starts from the longest vectors as well, which are neighbours of many.
Equal vectors are one node, whose smallest ids are kept, so copies do not crowd the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import map_arrow

K = 30
#: Random-projection orders, vectors per leaf of the start graph, and neighbours taken there.
TREES, LEAF, EARLY = 8, 400, 12
ROUNDS, LEAST_CHANGE = 5, 0.03
#: Newest neighbours on either side that one join of a round uses: every edge is new once.
SAMPLE = 16
#: Of a search: the vectors kept, those expanded per step, and the longest vectors it starts from.
BEAM, WIDE, LONG = 160, 40, 160
#: Reverse edges of a vector that a search follows besides its own.
BACK = 20
#: Vectors that one task scores against the queries that reached them.
SHARD = 4096


def _dense(lists) -> np.ndarray:
    flat = lists.values.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    return flat[ends[0] : ends[-1]].reshape(len(lists), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that have an id and a vector of finite components that are not all zero."""
    plain = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(plain).where(F.exists("embedding", lambda v: v != 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """(node, v, ids): distinct vectors under their smallest id, with their ``keep`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ranked = rows.groupBy("v", "vec_id").count().withColumn("r", rank).where(F.col("r") <= keep)
    return ranked.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("node", "v", "ids")


def lifted(found: DataFrame) -> DataFrame:
    """(node, x): vectors with the coordinate that gives all the same length, in single precision."""
    size = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    most = found.agg(F.max(size)).collect()[0][0] or 0.0
    more = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(most)) - size))
    return found.select("node", F.concat("v", F.array(more)).cast("array<float>").alias("x"))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(node, near): the k best of (node, other, s) by score, then id, as an array of structs."""
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "other"))
    top = pairs.withColumn("r", best).where(F.col("r") <= k)
    return top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("other"), F.col("new")))).alias("near"))


def _all_pairs(limit: int):
    """Scores of the best ``limit`` others of each member of a leaf."""

    def run(pdf):
        import pandas as pd

        x, ids = np.stack(pdf["x"].to_numpy()), pdf["node"].to_numpy()
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(limit, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"node": [], "other": [], "s": []}).astype({"node": "int64", "other": "int64", "s": "float32"})
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(ids, k), "other": ids[at].ravel(), "s": np.take_along_axis(s, at, 1).ravel()})

    return run


def start(points: DataFrame, n: int, k: int) -> DataFrame:
    """(node, other, s) from leaves of about LEAF vectors, by the signs of random projections."""
    dim = len(points.first()["x"])
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    planes = np.random.default_rng(5).normal(size=(TREES, max(1, bits), dim))

    def run(batches):
        for b in batches:
            x = _dense(b.column("x"))
            for t in range(TREES):
                leaf = ((x @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(leaf.astype(np.int64)), b.column("node"), b.column("x")], ["tree", "leaf", "node", "x"])

    leaves = map_arrow(points, run, "tree long, leaf long, node long, x array<float>")
    # Leaves are uneven: large ones are dealt into parts of bounded size, by hash.
    sizes = leaves.groupBy("tree", "leaf").count().select("tree", "leaf", F.ceil(F.col("count") / (2 * LEAF)).alias("parts"))
    dealt = leaves.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    return dealt.groupBy("tree", "leaf", "part").applyInPandas(_all_pairs(min(k, EARLY)), "node long, other long, s float").select("node", "other", "s").distinct()


def descend(graph: DataFrame, points: DataFrame, k: int) -> tuple[DataFrame, float]:
    """One round: neighbours of a vector, on either side, are proposed to each other.

    A pair is tried only if one of its two edges is new. Returns the new graph and the
    share of its edges that changed.
    """
    edges = graph.select("node", F.posexplode("near").alias("r", "e")).select("node", "r", "e.other", "e.new")
    back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "new", F.xxhash64("node", "other").alias("h"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), "h"))
    back = back.withColumn("r", turn).where(F.col("r") <= SAMPLE).select("node", "other", "new")
    fresh = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), "r"))
    ahead = edges.withColumn("q", fresh).where(F.col("q") <= SAMPLE).select("node", "other", "new", "r")
    hood = ahead.select("node", "other", "new").union(back).groupBy("node", "other").agg(F.max("new").alias("new"))
    # A proposal must beat the worst of the neighbours that a vector has.
    worst = graph.select("node", F.when(F.size("near") < k, F.lit(float("-inf"))).otherwise(-F.element_at("near", -1)["d"]).cast("float").alias("worst"))
    known = points.join(worst, "node").select(F.col("node").alias("other"), "x", "worst")
    hood = hood.join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "new", "x", "worst")).alias("m"))

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for members in b.column("m"):
                flat = members.values
                ids = flat.field("other").to_numpy()
                new = flat.field("new").to_numpy(zero_copy_only=False)
                x = _dense(flat.field("x"))
                s = (x @ x.T).astype(np.float32)
                better = s > flat.field("worst").to_numpy()[:, None]
                tried = (new[:, None] | new[None, :]) & better & ~np.eye(len(ids), dtype=bool)
                i, j = np.nonzero(tried)
                out[0].append(ids[i])
                out[1].append(ids[j])
                out[2].append(s[i, j])
            cols = [np.concatenate(c) if c else np.empty(0) for c in out]
            # What a batch proposes to one vector is cut to its best before it is shuffled.
            keep = _best(cols[0].astype(np.int64), cols[1].astype(np.int64), cols[2], k)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][keep].astype(np.int64)), pa.array(cols[1][keep].astype(np.int64)), pa.array(cols[2][keep].astype(np.float32))], ["node", "other", "s"])

    tried = map_arrow(hood, run, "node long, other long, s float")
    # Edges not tried this time stay new for the next round.
    used = ahead.select("node", F.col("other").alias("o")).withColumn("used", F.lit(True))
    old = graph.select("node", F.explode("near").alias("e")).select("node", F.col("e.other").alias("other"), (-F.col("e.d")).alias("s"), F.col("e.new").alias("new"))
    old = old.join(used, [old["node"] == used["node"], old["other"] == used["o"]], "left").select(old["node"], old["other"], "s", (F.col("new") & F.col("used").isNull()).alias("new"), F.lit(True).alias("had"))
    both = old.union(tried.select("node", "other", "s", F.lit(True).alias("new"), F.lit(False).alias("had")))
    merged = both.groupBy("node", "other").agg(F.max("s").alias("s"), F.max("had").alias("had"), F.min("new").alias("new"))
    merged = merged.withColumn("new", F.col("new") | ~F.col("had"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "other"))
    top = merged.withColumn("r", best).where(F.col("r") <= k)
    out = top.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "other", "new"))).alias("near"), F.sum(F.when(F.col("had"), 0).otherwise(1)).alias("changed")
    )
    out = cut(out, "graph")
    seen = out.agg(F.sum("changed").alias("c"), F.sum(F.size("near")).alias("n")).collect()[0]
    return out.select("node", "near"), (seen["c"] or 0) / max(1, seen["n"] or 1)


def _best(node: np.ndarray, other: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct proposals of each node."""
    order = np.lexsort((other, -s, node))
    n, o = node[order], other[order]
    first = np.ones(len(n), bool)
    first[1:] = (n[1:] != n[:-1]) | (o[1:] != o[:-1])
    order, n = order[first], n[first]
    begins = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else np.empty(0, int)
    rank = np.arange(len(n)) - np.repeat(begins, np.diff(np.r_[begins, len(n)]))
    return order[rank < k]


def build(points: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """The graph: (node, near), near sorted by falling inner product of the lifted vectors."""
    n = points.count()
    if n < 2:
        return points.select("node", F.array().cast("array<struct<d:float,other:bigint,new:boolean>>").alias("near"))
    graph = cut(_top(start(points, n, k).withColumn("new", F.lit(True)), k), "graph")
    for _ in range(rounds):
        graph, changed = descend(graph, points, k)
        if changed < LEAST_CHANGE:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, points: DataFrame, beam: int = BEAM) -> DataFrame:
    """(node, other): for each node of ``queries``, the ``beam`` nearest others that a greedy walk meets.

    The walk starts at the query's own neighbours and at the longest vectors, and ends
    when all of its beam is expanded; a beam only improves, so it does end. Vectors lie in shards; a step brings each query once to every shard that
    holds vectors it has reached, and only scores that enter the beam come back.
    """
    shards = max(1, points.count() // SHARD)
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    ahead = graph.select("node", F.transform("near", lambda e: e["other"]).alias("next"))
    edges = graph.select("node", F.posexplode("near").alias("r", "e")).select(F.col("e.other").alias("node"), F.col("node").alias("from"), "r")
    turn = F.row_number().over(Window.partitionBy("node").orderBy("r", "from"))
    behind = edges.withColumn("t", turn).where(F.col("t") <= BACK).groupBy("node").agg(F.collect_list("from").alias("more"))
    links = ahead.join(behind, "node", "left").select("node", F.array_union("next", F.coalesce("more", F.array().cast("array<bigint>"))).alias("next"))
    links = cut(links, "links")
    placed = cut(points.withColumn("shard", shard("node")), "shards")
    # Without the added coordinate a query's products are those of the original vectors.
    plain = F.concat(F.slice("x", F.lit(1), F.size("x") - 1), F.array(F.lit(0.0).cast("float")))
    own = cut(queries.join(points, "node").select(F.col("node").alias("q"), plain.alias("qx")), "queries")
    long_ = [r["node"] for r in points.orderBy(F.element_at("x", -1), "node").limit(LONG).collect()]

    def scored(pairs: DataFrame, least: DataFrame | None) -> DataFrame:
        """(q, c, s, done) of the pairs that beat the query's ``least``."""
        asked = pairs.groupBy("q", shard("c").alias("shard")).agg(F.collect_list("c").alias("cs")).join(own, "q")
        floor = F.lit(float("-inf")).cast("float")
        asked = asked.withColumn("least", floor) if least is None else asked.join(least, "q", "left").withColumn("least", F.coalesce("least", floor))
        return asked.groupBy("shard").cogroup(placed.groupBy("shard")).applyInPandas(_score_shard, "q long, c long, s float").withColumn("done", F.lit(False))

    def beamed(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))
        front = F.row_number().over(Window.partitionBy("q").orderBy("done", F.desc("s"), "c"))
        kept = rows.withColumn("r", rank).where(F.col("r") <= beam).drop("r")
        return cut(kept.withColumn("go", (front <= WIDE) & ~F.col("done")), "beam")

    begin = F.array_union("next", F.array(*map(F.lit, long_)).cast("array<bigint>"))
    first = own.select("q").join(links, F.col("q") == F.col("node")).select("q", F.explode(begin).alias("c")).where("q != c")
    state = beamed(scored(first.distinct(), None))
    while (front := state.where("go")).limit(1).count():
        reached = front.select("q", "c").join(links, F.col("c") == F.col("node")).select("q", F.explode("next").alias("c")).where("q != c")
        fresh = reached.distinct().join(state.select("q", "c"), ["q", "c"], "left_anti")
        full = state.groupBy("q").agg(F.count("*").alias("n"), F.min("s").alias("least")).where(F.col("n") >= beam).select("q", "least")
        old = state.select("q", "c", "s", (F.col("done") | F.col("go")).alias("done"))
        state = beamed(old.union(scored(fresh, full)))
    return state.select(F.col("q").alias("node"), F.col("c").alias("other"))


def _score_shard(asked, held):
    """Scores of a shard's vectors with the queries that reached them, above each query's least."""
    import pandas as pd

    none = pd.DataFrame({"q": [], "c": [], "s": []}).astype({"q": "int64", "c": "int64", "s": "float32"})
    if not len(asked) or not len(held):
        return none
    x, ids = np.stack(held["x"].to_numpy()), held["node"].to_numpy()
    order = np.argsort(ids)
    x, ids, out = x[order], ids[order], []
    for q, cs, qx, least in zip(asked["q"], asked["cs"], asked["qx"], asked["least"]):
        s = x[np.searchsorted(ids, cs)] @ qx
        good = s > least
        if good.any():
            out.append((np.full(int(good.sum()), q), np.asarray(cs)[good], s[good]))
    if not out:
        return none
    return pd.DataFrame({"q": np.concatenate([o[0] for o in out]), "c": np.concatenate([o[1] for o in out]), "s": np.concatenate([o[2] for o in out]).astype("float32")})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id ``every`` divides.

    ``score`` is the inner product in double precision on the original vectors; ties go to
    the smaller id; a query's own id is no candidate, its copies are. Null vectors, zero
    vectors and those with null or non-finite components take no part. Rows that repeat
    an id and vector count once.
    """
    rows = usable(vectors.select("vec_id", "embedding"))
    found = cut(nodes(rows, k + 1), "nodes")
    points = cut(lifted(found), "points")
    graph = build(points, max(K, k))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    asked = cut(asked.join(found.select("node", "v"), "v").select("vec_id", "node", "v"), "asked")
    met = search(asked.select("node").distinct(), graph, points, max(BEAM, 2 * k))
    # The query's own node holds its copies.
    met = met.union(asked.select("node", F.col("node").alias("other")).distinct())
    pairs = asked.join(met, "node").join(found.select(F.col("node").alias("other"), F.col("v").alias("w"), "ids"), "other")
    exact = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = pairs.select(F.col("vec_id").alias("query_id"), exact.alias("score"), F.explode("ids").alias("vec_id")).where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
