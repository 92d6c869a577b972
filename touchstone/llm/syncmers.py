"""Document fingerprints from closed syncmers.

A k-mer of bytes is chosen if the smallest of its inner s-mers lies at its first or last
place. That depends on the k-mer alone, so equal passages choose equal anchors whatever
surrounds them. A fingerprint is the bottom sketch of the anchors' hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import map_arrow, texts_of
from .order import ROW_BITS, ordered

K, S = 24, 8
#: Hashes in a fingerprint.
SKETCH = 64
_WINDOW = K - S + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def choose(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of a whole text, places in bytes.

    A text shorter than a k-mer is one anchor at 0; an empty text has none.
    """
    raw = text.encode()
    if len(raw) < K:
        if not raw:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(raw)], np.uint32)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        b = b[:-step] | (b[step:] << np.uint64(shift))
    h = _mix(b)
    low, width = h, 1
    while 2 * width <= _WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _WINDOW:
        low = np.minimum(low[: -(_WINDOW - width)], low[_WINDOW - width :])
    first, last = h[: len(low)], h[_WINDOW - 1 :]
    at = np.flatnonzero((first == low) | (last == low))
    mid = h[at + S]
    return at, (_mix(h[at] * np.uint64(3) + mid * np.uint64(5) + last[at] * np.uint64(7)) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> np.ndarray:
    return np.unique(choose(text)[1])[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the anchors behind two sketches; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[: max(len(a), len(b))]
    return float(np.isin(both, a).__and__(np.isin(both, b)).sum() / len(both))


def written(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def parsed(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, at, hash), one row per anchor, for matching passages by position."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                at, h = choose(t)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(h.astype(np.int64))], ["doc_id", "at", "hash"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, at long, hash long")


def fingerprints(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    """Add ``out`` to every row, as hexadecimal digits; an empty or null text has none ("")."""
    kept = [k for k in docs.columns if k != out]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array([written(sketch(t)) for t in texts_of(b)], pa.string())], [*kept, out])

    return map_arrow(docs.select(*kept), run, docs.select(*kept).withColumn(out, F.lit("")).schema)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(i, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> list:
    new = edited(text, following)
    s = sketch(new)
    return [i, len(text), hashlib.sha256(new.encode()).hexdigest(), written(own), written(s), likeness(own, s), likeness(own, theirs)]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Documents go by doc_id (nulls first, repeated ids by a hash of the text), and the last
    is followed by the first; a single row follows itself. Texts are shuffled once, and
    compressed for that; a partition's last row waits for the first row of the next partition that has any.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))

    def packed(batches):
        pack = zstandard.ZstdCompressor()
        for b in batches:
            z = pa.array([pack.compress(t.encode()) for t in texts_of(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), z], ["doc_id", "h", "z"])

    placed = ordered(map_arrow(rows, packed, "doc_id long, h long, z binary"), ["doc_id", "h"])

    def run(batches):
        held, head, unpack = None, None, zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            texts = (unpack.decompress(z).decode() for z in b.column("z").to_pylist())
            for i, at, t in zip(b.column("doc_id").to_pylist(), b.column("at").to_pylist(), texts):
                own = sketch(t)
                if held:
                    rows.append([*_compared(held[0], held[1], held[2], t, own), None, None, None])
                if head is None:
                    head = (i, t, own, at >> ROW_BITS)
                held = (i, t, own, at >> ROW_BITS)
            yield _batch(rows)
        if held:
            ends = [[i, len(t), None, written(own), None, None, None, part, role, t] for role, (i, t, own, part) in (("head", head), ("tail", held))]
            yield _batch(ends)

    def _batch(rows):
        cols = list(zip(*rows)) or [[]] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*_TYPES, pa.int64(), pa.string(), pa.string()])], [*_COLS, "part", "role", "text"])

    prints = cut(map_arrow(placed, run, f"{_SCHEMA}, part long, role string, text string"), "prints")
    # One row per partition on either side.
    heads = prints.where("role = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = heads.select("part", F.lead("part").over(Window.orderBy("part")).alias("up"), F.min("part").over(Window.partitionBy()).alias("low"))
    following = order.select("part", F.coalesce("up", "low").alias("next_part"))
    tails = prints.where("role = 'tail'").select("part", "doc_id", "text", "fingerprint").join(following, "part")
    ends = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def finish(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("doc_id", "text", "fingerprint", "next_text", "next_print")]
            rows = [_compared(i, t, parsed(f), nt, parsed(nf)) for i, t, f, nt, nf in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, _TYPES)], _COLS)

    return prints.where("role IS NULL").select(*_COLS).union(map_arrow(ends, finish, _SCHEMA))
