"""MinHash near-duplicate linking with odd sketches.

Documents are sets of word shingles. Equal sets fold into one class first. Classes whose
MinHash bands collide are candidates; a parity bitmap of the MinHash samples (an odd
sketch) estimates their similarity from the population count of an XOR and drops pairs
that are far below the threshold; what is left is confirmed on the full sets.

A group of n near copies would give n * n / 2 candidates. Instead:

1. every member of a bucket is compared with the bucket's pivot, the member with the
   smallest share of shingles that no other candidate has, and confirmed links are
   joined into components;
2. whoever is outside the pivot's component is compared with the other components of
   the bucket, but only where set sizes and private shingles leave room for a link:
   a link needs ``|a & b| >= t / (1 + t) * (|a| + |b|)``, and ``|a & b|`` cannot exceed
   what either side shares with anybody;
3. in a hot bucket, shingles that few of its members have are set apart. Pairs without
   a common rare shingle need room among the common ones alone, which edited copies
   lack; pairs with one are found by a join on rare shingles, whose rows are bounded by
   RARE times the number of shingles.

Every step is a query of its own on stored tables: Spark re-plans, logs and keeps a running query
once per finished exchange, so what the driver holds grows with the square of the exchanges in one.
Texts are read twice and never shuffled: a filter picks those of candidates where they are read, and their
sets meet the ids exactly.

All bounds are exact, so no link between candidates is lost. A pair at the threshold
of 0.85 misses all 32 bands of 5 samples with a chance below 1e-8 (3e-6 at 0.8).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import map_arrow, texts_of

BANDS, ROWS = 32, 5
#: Bits of an odd sketch, as 64-bit words.
SKETCH_WORDS = 8
#: A candidate is dropped if its estimate is this far below the threshold: six standard
#: deviations of the estimate at the threshold.
SLACK = 0.2
WORDS_CACHED = 400_000
#: Members of a bucket up to which step 2 compares pairs; holders of a rare shingle at most.
HOT, RARE = 64, 16
#: Bits per id of the filter that picks texts, its probes, and its size at most (8 MB).
FILTER_BITS, PROBES, MOST_BITS = 12, 4, 1 << 26

_SEEDS = np.random.default_rng(20240229)
_MUL = _SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    """Word to 64-bit hash, filled on demand and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text.

    Fewer words than ``k`` are one shingle; no words are the empty set.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set, in blocks so that long texts need no large table."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        x = _MUL[:, None] * part[None, :] + _ADD[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        best = np.minimum(best, x.min(1))
    return best


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    table = values.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + table[:, i])
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    at = mix(values.astype(np.uint64) + (np.arange(len(values), dtype=np.uint64) << np.uint64(32)))
    bits = np.bincount((at % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0] + [len(r) for r in rows])
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, set size ``n``, a 128-bit key of the set, band keys, odd sketch."""

    def run(batches):
        none = np.empty(0, np.uint64)
        for b in batches:
            n, k1, k2, keys, odd = [], [], [], [], []
            for t in texts_of(b):
                s = shingles(t, words)
                m = minhashes(s) if len(s) else none
                n.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)))
                keys.append(bands(m) if len(s) else none)
                odd.append(odd_sketch(m) if len(s) else none)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(keys), _lists(odd)],
                ["doc_id", "n", "k1", "k2", "bands", "odd"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, k1 long, k2 long, bands array<long>, odd array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: node (the doc_id), the first half of the set's key, and the full set."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, words) for t in texts_of(b)]
            k1 = pa.array([int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), k1, _lists(sets)], ["node", "k1", "shingles"])

    return map_arrow(docs.select("doc_id", "text"), run, "node long, k1 long, shingles array<long>")


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id), and a few others, picked where they are read.

    One row, a Bloom filter of the ids, is broadcast, so that texts are not shuffled at any size. It
    misses no id; beyond MOST_BITS it only lets more rows through.
    """
    bits = min(MOST_BITS, 1 << max(6, (FILTER_BITS * ids.count()).bit_length()))
    probes = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(bits)) for i in range(PROBES)]
    at = ids.select(F.explode(F.array(*probes)).alias("at")).select(
        F.shiftright("at", 6).alias("place"), F.expr("shiftleft(1L, int(at % 64))").alias("word")
    )
    none = ids.sparkSession.range(bits // 64).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("word"))
    words = at.union(none).groupBy("place").agg(F.bit_or("word").alias("word"))
    one = cut(words.agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("_words")), "filter")
    inside = F.lit(True)
    for p in probes:
        inside &= F.getbit(F.get("_words", F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
    return docs.where("doc_id IS NOT NULL").join(F.broadcast(one), inside, "left_semi")


def xor_count(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def similar(a: str, b: str, least: float) -> Column:
    """Whether the odd-sketch estimate leaves room for a similarity of ``least``.

    With m bits and k samples an XOR count of z estimates J as 1 + m / 4k * ln(1 - 2z / m).
    """
    m, k = 64 * SKETCH_WORDS, BANDS * ROWS
    most = m / 2 * (1 - np.exp((least - SLACK - 1) * 4 * k / m))
    return xor_count(a, b) <= F.lit(int(np.ceil(most)))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) can reach.

    Labels spread along edges and jump to their label's label, so that the number of
    rounds is logarithmic in the longest path. Every round is a written table.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        near = (
            both.join(now.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        step = now.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = step.alias("s").join(
            now.select(F.col("node").alias("up"), F.col("comp").alias("over")), F.col("comp") == F.col("up"), "left"
        )
        new = cut(jump.select("node", F.least("comp", F.coalesce("over", "comp")).alias("comp"), "old"), "labels")
        if new.where(F.col("comp") != F.col("old")).limit(1).count() == 0:
            return new.select("node", "comp")
        now = new.select("node", "comp")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach ``num / den``."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("u"))
        .where((num + den) * F.col("i") >= num * F.col("u")).select("a", "b")
    )


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Links have ``den * |a & b| >= num * |a | b|``; a component is named by its smallest
    doc_id, whose row is kept. Null texts and texts without words have no shingles, link
    with nothing and are kept. Rows count one by one: if an id repeats with equal texts, its
    rows share a component; if with others, each goes with its own text, and ids that lead
    two components are kept in both. A row with a null id takes the component of its class,
    if that has one, and is kept only if not.
    An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    least = num / den
    sigs = cut(signatures(docs, words), "signatures")
    full = sigs.where("n > 0")
    classes = full.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("first"), F.min_by(F.struct("bands", "odd"), F.col("doc_id")).alias("s")
    )
    # An id with several texts leads several classes: all but the first get a node of their own.
    nth = F.row_number().over(Window.partitionBy("first").orderBy("k1", "k2", "n"))
    named = classes.where("first IS NOT NULL").select("k1", "k2", "n", "first", "s.bands", "s.odd").withColumn("nth", nth)
    node = F.when(F.col("nth") == 1, F.col("first")).otherwise(F.xxhash64("first", "k1", "k2", "n"))
    reps = cut(named.withColumn("node", node), "classes")

    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut(keyed.join(shared, "key"), "members")
    wanted = members.select("node").distinct()
    led = cut(reps.select("node", "first", "k1").join(wanted, "node", "left_semi"), "led")
    texts = likely(docs, led.select(F.col("first").alias("doc_id")))
    sets = shingle_sets(texts, words).withColumnRenamed("node", "first").dropDuplicates(["first", "k1"])
    sets = cut(sets.join(led, ["first", "k1"]).select("node", "shingles"), "sets")
    # Shingles that one candidate alone has; two sets with one hash would only hide one.
    private = (
        sets.select("node", F.explode("shingles").alias("h")).groupBy("h")
        .agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
        .groupBy("node").agg(F.count("*").alias("own"))
    )
    info = (
        reps.select("node", "n", "odd").join(led.select("node"), "node", "left_semi").join(private, "node", "left")
        .withColumn("own", F.coalesce("own", F.lit(0)))
    )
    # The largest partner that a node could link with, from what it shares with anybody.
    room = F.floor((F.col("n") - F.col("own")) * (num + den) / F.lit(num)) - F.col("n")
    info = cut(info.withColumn("room", room), "nodes")
    m = cut(members.join(info.select("node", "n", "own", "room"), "node"), "members")

    pivots = m.groupBy("key").agg(
        F.min(F.struct(F.col("own") / F.col("n"), "node")).alias("p"), F.min("n").alias("n_min"), F.max("room").alias("room_max"), F.count("*").alias("c")
    ).select("key", F.col("p.node").alias("pivot"), "n_min", "room_max", "c")
    pivots = cut(pivots, "pivots")
    stars = (
        m.join(pivots, "key").where("node != pivot")
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    )
    found = cut(_confirmed(_possible(cut(stars, "stars"), info, least, num, den), sets, num, den), "links")
    comps = components(found)

    m = cut(m.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    stay = comps.select(F.col("node").alias("pivot"), F.col("comp").alias("main"))
    mixed = pivots.join(stay, "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
    open_ = cut(m.join(mixed, "key").where("comp != main AND room >= n_min AND room_max >= n"), "open")
    keys = reps.select("node", "bands")
    crossing = cut(_crossing(open_.where(f"c <= {HOT}"), m, keys), "crossing")
    hot = open_.where(f"c > {HOT}")
    if hot.limit(1).count():
        crossing = cut(crossing.union(_hot_crossing(hot, m, keys, sets, num, den)).distinct(), "crossing")
    more = cut(_confirmed(_possible(crossing, info, least, num, den), sets, num, den), "links")
    if more.limit(1).count():
        comps = components(found.union(more))

    named = reps.select("k1", "k2", "n", "node", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = reps.where("nth > 1").select("node").limit(1).count()
    if own:  # components may be led by such a node
        names = named.groupBy("comp").agg(F.min("first").alias("name"))
        named = named.join(names, "comp").withColumn("comp", F.col("name"))
    named = cut(named.select("k1", "k2", "n", "comp"), "named")
    out = sigs.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _crossing(open_: DataFrame, members: DataFrame, bands: DataFrame) -> DataFrame:
    """(a, b): open nodes and the members of their buckets that are in other components and have room.

    Near copies share many buckets; a pair is taken in the first of those in which ``a`` is open.
    """
    where = open_.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("at"))
    left = open_.join(where, "node").select("at","key", "pivot", F.col("node").alias("a"), F.col("n").alias("na"), F.col("room").alias("ra"), F.col("comp").alias("ca"))
    right = members.join(open_.select("key").distinct(), "key", "left_semi").join(bands, "node").select(
        "key", "bands", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("room").alias("rb"), F.col("comp").alias("cb")
    )
    pairs = left.join(right, "key").where("ca != cb AND na <= rb AND nb <= ra AND b != pivot AND array_intersect(at, bands)[0] = key")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hot_crossing(hot: DataFrame, members: DataFrame, bands: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The same for hot buckets, by rare and common shingles."""
    keys = hot.select("key").distinct()
    inside = cut(members.join(keys, "key", "left_semi"), "hot")
    nodes = inside.select("node", "n", "comp").distinct()
    tokens = cut(sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("h")), "tokens")
    few = tokens.groupBy("h").agg(F.count("*").alias("df")).where(f"df <= {RARE}")
    rare = cut(tokens.join(few, "h"), "rare")
    counts = rare.groupBy("node").agg(F.count("*").alias("rare"))
    nodes = nodes.join(counts, "node", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    nodes = cut(nodes.withColumn("room", F.floor((F.col("n") - F.col("rare")) * (num + den) / F.lit(num)) - F.col("n")), "nodes")
    # Without a common rare shingle.
    narrow = cut(inside.drop("room").join(nodes.select("node", "room"), "node"), "narrow")
    bounds = narrow.groupBy("key").agg(F.min("n").alias("n_min"), F.max("room").alias("room_max"))
    still = hot.select("key", "pivot", "node").join(narrow, ["key", "node"]).join(bounds, "key").where("room >= n_min AND room_max >= n")
    plain = cut(_crossing(cut(still, "still"), narrow, bands), "crossing")
    # With one: counted per pair.
    side = lambda s, frame: frame.join(nodes, "node").select("h", *[F.col(k).alias(f"{k}_{s}") for k in ("node", "n", "comp", "rare")])
    shared = rare.where("df > 1").select("h", "node")
    left = side("a", shared.join(hot.select("node").distinct(), "node", "left_semi"))
    pairs = left.join(side("b", shared), "h").where("node_a != node_b AND comp_a != comp_b")
    met = pairs.groupBy("node_a", "node_b").agg(F.count("*").alias("s"), *[F.first(k).alias(k) for k in ("n_a", "n_b", "rare_a", "rare_b")])
    met = met.where(f"{num + den} * (least(n_a - rare_a, n_b - rare_b) + s) >= {num} * (n_a + n_b)")
    met = cut(met, "met")
    return plain.union(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


def _possible(pairs: DataFrame, info: DataFrame, least: float, num: int, den: int) -> DataFrame:
    """Pairs that sizes, private shingles and odd sketches leave open."""
    side = lambda s: info.select(F.col("node").alias(s), F.col("odd").alias(f"o{s}"), F.col("n").alias(f"n{s}"), F.col("room").alias(f"r{s}"))
    sized = f"{den} * least(na, nb) >= {num} * greatest(na, nb) AND na <= rb AND nb <= ra"
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized).where(similar("oa", "ob", least)).select("a", "b")
