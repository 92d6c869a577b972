"""Compression of vectors to codes of their parts, with exact integer codebooks.

Components become integers, vectors are cut into equal consecutive parts, and each part
is named by the nearest entry of its position's codebook. Codebooks are trained by rounds
of assignment and averaging; a round is one pass over the vectors that returns sums per
part and entry, so what reaches the driver is bounded by the size of the codebooks.

The nearest entry is found by slices and bitmasks. In each dimension the entries'
coordinates are sorted, and beside them stand prefix masks of the entries so far. The
coordinates within a radius of a part are a range, whose entries are the exclusive or of
two prefix masks; the masks of all dimensions, ANDed, are the entries in the box. The
nearest entry lies there if any entry of the box is within the radius itself, so only
those candidates are measured; parts without such an entry try again with twice the
radius. The first radius is the mean error of the round before.

Odd rows: vectors that are null, empty or hold null or non-finite components are left
out, and so are those whose length differs from that of the first row by vec_id. Rows
without vec_id are coded as well and come last in that order; of rows that share a vec_id,
the smaller vector comes first. Repeated rows count each. With fewer rows than entries the
codebooks are smaller; an empty table gives no rows. Ties go to the lower index. Integers
beyond 2^27 (components beyond 32,768) are cut off there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are measured at once.
ROWS = 4096
#: Distinct labels whose sums are broadcast; more are joined by shuffle.
FEW_LABELS = 20_000
#: Integers up to this size keep squared distances of parts within 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers (parts, entries, width); ``radius``: a first guess per part, for the search."""

    entries: np.ndarray
    radius: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Slices:
    """The entries of one codebook, sorted in every dimension, with prefix masks of 64 entries a word."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, 0).T.copy()
        words = -(-len(entries) // 64)
        self.prefix = np.zeros((entries.shape[1], len(entries) + 1, words), np.uint64)
        for d in range(entries.shape[1]):
            for k, e in enumerate(order[:, d]):
                self.prefix[d, k + 1] = self.prefix[d, k]
                self.prefix[d, k + 1, e // 64] |= np.uint64(1) << np.uint64(e % 64)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows, words) of the entries within ``radius`` in every dimension."""
        found = None
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, "right")
            here = self.prefix[d, high] ^ self.prefix[d, low]
            found = here if found is None else found & here
        return found

    def nearest(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of ``x``."""
        index, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        rest, reach = np.arange(len(x)), max(1, int(radius))
        while len(rest):
            masks = self.candidates(x[rest], np.full(len(rest), reach))
            best[rest] = np.iinfo(np.int64).max  # a lower index may tie with one that a smaller box held
            for e in range(len(self.entries)):
                at = rest[(masks[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) == 1]
                far = ((x[at] - self.entries[e]) ** 2).sum(1)
                nearer = far < best[at]
                index[at[nearer]], best[at[nearer]] = e, far[nearer]
            # An entry outside the box is farther than the radius, and so than these.
            rest = rest[best[rest] > reach * reach]
            reach *= 2
        return index, best


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of vectors of one length."""
    width = len(column[0])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(-1, width)


def _batches(batches, name: str = "embedding"):
    """Record batches of at most ROWS rows, with their integer vectors."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, _integers(part.column(name))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has components, all of them finite."""
    plain = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(plain)


def _first(kept: DataFrame, n: int) -> list:
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(n).select("embedding").collect()
    return [r[0] for r in rows]


def _sums(books: Codebooks):
    """Counts, component sums and summed errors of each part and entry in one task."""
    parts, entries, width = books.entries.shape

    def run(batches):
        slices = [Slices(b) for b in books.entries]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        errors = np.zeros((parts, entries))
        for _, x in _batches(batches):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                index, far = slices[p].nearest(own, books.radius[p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, own)
                np.add.at(errors[p], index, far)
        p, e = np.nonzero(count)
        columns = [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(errors[p, e])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total", "error"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from all usable vectors. A round's sums are exact and reach the driver as parts x entries rows."""
    if entries > 256:
        raise ValueError("a code has one byte per part")
    kept = usable(vectors)
    first = _first(kept, 1)
    if not first:
        return Codebooks(np.zeros((parts, 0, 1), np.int64), np.ones(parts))
    width = len(first[0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("embedding") == width)
    start = _integers(pa.array(_first(kept, entries)))
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    # Before any round, half the mean distance of two entries will do as a radius.
    radius = np.array([np.sqrt(((b[:, None] - b[None]) ** 2).sum(2)).mean() / 2 for b in books])
    wide = "decimal(38,0)"
    for _ in range(rounds):
        found = kept.select("embedding").mapInArrow(_sums(Codebooks(books, radius)), "part long, entry long, n long, total array<long>, error double")
        columns = [F.sum(F.col("total")[i].cast(wide)).alias(f"t{i}") for i in range(books.shape[2])]
        rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), *columns).collect()
        counts, errors = np.zeros(parts), np.zeros(parts)
        for r in rows:
            books[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(books.shape[2])]
            counts[r["part"]] += r["n"]
            errors[r["part"]] += r["error"]
        radius = np.sqrt(errors / np.maximum(counts, 1))
    return Codebooks(books, radius)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Usable rows without their vector, with ``code`` (one byte per part) and ``error``, the sum of squared distances."""
    parts, _, width = books.entries.shape
    kept = usable(vectors).where(F.size("embedding") == parts * width)
    others = [c for c in kept.columns if c not in ("embedding", "code", "error")]
    schema = kept.select(*others).schema.add("code", "binary").add("error", "long")

    def run(batches):
        slices = [Slices(b) for b in books.entries]
        for b, x in _batches(batches):
            found = [s.nearest(x[:, p * width : (p + 1) * width], books.radius[p]) for p, s in enumerate(slices)]
            code = np.column_stack([i for i, _ in found]).astype(np.uint8)
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            error = sum(f for _, f in found)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], codes, pa.array(error)], [*others, "code", "error"])

    return kept.select("embedding", *others).mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, name: str = "embedding") -> DataFrame:
    """Add the approximate vector that a code stands for."""
    parts = books.entries.shape[0]
    vectors = F.array(*[F.array(*[F.array(*[F.lit(int(c)) for c in e]) for e in book]) for book in books.entries])
    # Bytes are read as hexadecimal digits: two for each part.
    at = lambda p: F.conv(F.substring(F.hex("code"), 2 * p + 1, 2), 16, 10).cast("int")
    pieces = F.concat(*[vectors[p][at(p)] for p in range(parts)])
    return coded.withColumn(name, F.transform(pieces, lambda v: (v + F.lit(0.5)) / SCALE))


def with_label_sums(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``, the sum of errors over rows of an equal label, nulls together.

    ``coded`` must be stored, as it is read twice. Sums of few labels are broadcast; those
    of many are joined by shuffle, where adaptive execution splits a hot label.
    """
    sums = cut(coded.groupBy(F.col(label).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-sums")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def compressed(vectors: DataFrame) -> tuple[DataFrame, Codebooks]:
    """Train on a table and store its codes: (stored rows with code and error, codebooks)."""
    books = train(vectors)
    return cut(encode(vectors, books), "codes"), books
