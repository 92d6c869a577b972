"""Exact removal of byte strings that start more than once in a collection.

A column-wise construction of the collection's Burrows-Wheeler transform takes one pass
over the external files per byte of the longest text (122,698 passes here), each a job of
its own on Spark. Instead, occurrences of a repeated string are brought together by their
content, in a fixed number of jobs:

1. every window of LENGTH bytes has an anchor, its smallest k-mer. Neighbouring windows
   share one, so anchors are about one byte in seventy. An anchor is determined by the
   window alone, so equal windows have equal anchors at equal places;
2. an anchor that occurs once belongs to windows that occur once;
3. all windows of one anchor are one span of text. A span that occurs again repeats all
   of its windows;
4. what is left are spans at the borders of repeats. They are compared with the other
   different spans of their anchor in blocks of BLOCK windows, aligned at the anchor. If
   the bytes that all windows of a block have in common occur once, so do its windows;
   if all bytes of a block occur again, so do all of its windows;
5. the windows of the few blocks in between are compared one by one.

Spans, blocks and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_arrow, texts_of

LENGTH = 200
K = 48
BLOCK = 16
#: Window starts that are searched at a time: 16 bits hold a place among them.
_STRETCH = 60000
_WINDOW = LENGTH - K + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _hashes(raw: bytes, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 8, 16, 32 ... bytes up to the largest of ``widths``."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for shift, step in ((8, 1), (16, 2), (32, 4)):
        b = b[:-step] | (b[step:] << np.uint64(shift))
    out, n = {8: _mix(b)}, 8
    while n < max(widths):
        out[2 * n] = _joined(out[n][:-n], out[n][n:])
        n *= 2
    return out


def window_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of all windows of LENGTH = 128 + 64 + 8 bytes."""
    h = _hashes(raw, (128,))
    n = len(raw) - LENGTH + 1
    return _joined(_joined(h[128][:n], h[64][128 : 128 + n]), h[8][192 : 192 + n])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, anchor's place) of each run of windows with one anchor."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    h = _hashes(raw, (32,))
    kmer = _joined(h[32][: len(raw) - K + 1], h[16][32 : len(raw) - K + 33])
    top = kmer & ~np.uint64(0xFFFF)
    at = np.empty(n, np.int64)
    for begin in range(0, n, _STRETCH):
        size = min(_STRETCH, n - begin)
        low = top[begin : begin + size + _WINDOW - 1] | np.arange(size + _WINDOW - 1, dtype=np.uint64)
        width = 1
        while 2 * width <= _WINDOW:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = _WINDOW - width
        low = np.minimum(low[:-rest], low[rest:]) if rest else low
        at[begin : begin + size] = begin + (low & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    return kmer[at[first]], first, last, at[first]


def _columns(out: list[list], types: list) -> list[pa.Array]:
    return [pa.array(np.concatenate(k) if k else np.empty(0), t) for k, t in zip(out, types)]


def _anchored(docs: DataFrame) -> DataFrame:
    """(a, h, first, last, pos) for every anchor of every row."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t, h in zip(texts_of(b), b.column("h").to_pylist()):
                a, *places = anchors(t.encode())
                for k, x in zip(out, (a.view(np.int64), np.full(len(a), h, np.int64), *places)):
                    k.append(x)
            yield pa.RecordBatch.from_arrays(_columns(out, types), ["a", "h", "first", "last", "pos"])

    return map_arrow(docs.where(f"octet_length(text) >= {LENGTH}").select("text", "h"), run, "a long, h long, first int, last int, pos int")


def _packed(docs: DataFrame) -> DataFrame:
    """(h, z): compressed texts, for the shuffles."""

    def run(batches):
        pack = zstandard.ZstdCompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([pack.compress(t.encode()) for t in texts_of(b)], pa.binary())], ["h", "z"])

    return map_arrow(docs.where(f"octet_length(text) >= {LENGTH}").select("text", "h"), run, "h long, z binary")


def _each(batches, *names):
    """(bytes, h, list, ...) of packed rows, batch by batch."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        yield ((unpack.decompress(z), *rest) for z, *rest in zip(b.column("z").to_pylist(), *(b.column(n).to_pylist() for n in names)))


def _spanned(held: DataFrame) -> DataFrame:
    """(a, span, size, h, first, last, pos, m) for the repeated anchors of each text; m rows have it."""

    def run(batches):
        for rows in _each(batches, "h", "m", "anchors"):
            out = [
                (r["a"], int(np.uint64(xxhash.xxh3_64_intdigest(raw[r["first"] : r["last"] + LENGTH])).astype(np.int64)), r["last"] - r["first"], h, r["first"], r["last"], r["pos"], m)
                for raw, h, m, found in rows
                for r in found
            ]
            cols = list(zip(*out)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["a", "span", "size", "h", "first", "last", "pos", "m"])

    return map_arrow(held, run, "a long, span long, size int, h long, first int, last int, pos int, m long")


def blocks_of(raw: bytes, a: int, first: int, last: int, pos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(core, whole, begin) of the blocks with windows first to last: hashes of the bytes that
    all windows of a block share, and of all of its bytes. Both hold the anchor and the
    block's place from it. A block that leaves the text has no whole; a hash of its own stands in.
    """
    begin = np.arange(pos - -(-(pos - first) // BLOCK) * BLOCK, last + 1, BLOCK)
    low = max(0, int(begin[0]))
    part = raw[low : int(begin[-1]) + BLOCK - 1 + LENGTH]
    h = _hashes(part, (128,))
    mark = _joined(np.full(len(begin), a & (2**64 - 1), np.uint64), (pos - begin).astype(np.uint64))
    at, core = begin - low + BLOCK - 1, LENGTH - BLOCK + 1
    cores = _joined(_joined(mark, h[128][at]), h[64][at + core - 64])
    inside = (begin >= 0) & (begin + BLOCK - 1 + LENGTH <= len(raw))
    at = np.where(inside, begin - low, 0)
    size = LENGTH + BLOCK - 1
    reach = np.minimum(at + size - 32, len(h[32]) - 1)
    whole = _joined(_joined(cores, h[128][np.minimum(at, len(h[128]) - 1)]), _joined(h[64][np.minimum(at + 128, len(h[64]) - 1)], h[32][reach]))
    own = _joined(_mix(cores + np.uint64(xxhash.xxh3_64_intdigest(raw))), begin.astype(np.uint64))
    return cores, np.where(inside, whole, own), begin


def _blocks(texts: DataFrame) -> DataFrame:
    """(core, whole, h, begin, first, last) for the blocks of the wanted spans."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for rows in _each(batches, "h", "wanted"):
            out: list[list] = [[], [], [], [], [], []]
            for raw, h, wanted in rows:
                for r in wanted:
                    core, whole, begin = blocks_of(raw, r["a"], r["first"], r["last"], r["pos"])
                    first, last = np.maximum(begin, r["first"]), np.minimum(begin + BLOCK - 1, r["last"])
                    for k, x in zip(out, (core.view(np.int64), whole.view(np.int64), np.full(len(core), h, np.int64), begin, first, last)):
                        k.append(x)
            yield pa.RecordBatch.from_arrays(_columns(out, types), ["core", "whole", "h", "begin", "first", "last"])

    return map_arrow(texts.select("z", "h", "wanted"), run, "core long, whole long, h long, begin int, first int, last int")


def _windows(texts: DataFrame) -> DataFrame:
    """(w, h, at): hashes of the windows in the ``wanted`` ranges of each text."""
    types = [pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        for rows in _each(batches, "h", "wanted"):
            out: list[list] = [[], [], []]
            for raw, h, wanted in rows:
                for r in wanted:
                    p, q = r["first"], r["last"]
                    for k, x in zip(out, (window_hashes(raw[p : q + LENGTH]).view(np.int64), np.full(q - p + 1, h, np.int64), np.arange(p, q + 1))):
                        k.append(x)
            yield pa.RecordBatch.from_arrays(_columns(out, types), ["w", "h", "at"])

    return map_arrow(texts.select("z", "h", "wanted"), run, "w long, h long, at int")


def _cleaned(texts: DataFrame) -> DataFrame:
    """(h, n_removed, n_spans, kept_sha256) from texts and their repeated windows."""

    def run(batches):
        for rows in _each(batches, "h", "ranges"):
            out: list[list] = [[], [], [], []]
            for raw, h, ranges in rows:
                kept, done, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for p, q in sorted((r["first"], r["last"]) for r in ranges):
                    if p > end:
                        if end >= 0:
                            removed, done = removed + end - begin, end
                        kept.update(raw[done:p])
                        begin, spans = p, spans + 1
                    end = max(end, q + LENGTH)
                removed += end - begin
                kept.update(raw[end:])
                for k, x in zip(out, (h, removed, spans, kept.hexdigest())):
                    k.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["h", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(texts.select("z", "h", "ranges"), run, "h long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Each byte covered by a string of LENGTH bytes that also starts anywhere else goes, as
    judged on the input. Null texts count as empty; texts below LENGTH bytes stay whole;
    equal rows are repeats of each other. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = cut(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole")), "rows")
    found = cut(_anchored(docs), "anchors")
    again = found.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a")
    lists = found.join(again, "a").groupBy("h").agg(F.collect_set(F.struct("a", "first", "last", "pos")).alias("anchors"))
    copies = rows.groupBy("h").agg(F.count("*").alias("m"))
    held = _packed(docs).join(lists, "h").join(copies, "h").dropDuplicates(["h"])
    held = cut(held.select("h", "z", "m", "anchors"), "texts")

    spans = cut(_spanned(held), "spans")
    kinds = cut(spans.groupBy("a", "span", "size").agg(F.sum("m").alias("c"), F.min(F.struct("h", "first", "last", "pos", "a")).alias("one")), "kinds")
    full = spans.join(kinds.where("c > 1").select("a", "span", "size"), ["a", "span", "size"], "left_semi").select("h", "first", "last")

    # Anchors with several different spans, one of which occurs once.
    mixed = kinds.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 AND least = 1").select("a")
    wanted = kinds.join(mixed, "a").select("one.*").groupBy("h").agg(F.collect_list(F.struct("a", "first", "last", "pos")).alias("wanted"))
    blocks = cut(_blocks(held.join(wanted, "h")), "blocks")
    alike = cut(blocks.groupBy("core", "whole").agg(F.count("*").alias("c"), F.min(F.struct("h", "first", "last")).alias("one")), "alike")
    block = blocks.join(alike.where("c > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("h", "first", "last")

    # The same once more for blocks.
    mixed = alike.groupBy("core").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 AND least = 1").select("core")
    open_ = alike.join(mixed, "core").select("one.*").groupBy("h").agg(F.collect_list(F.struct("first", "last")).alias("wanted"))
    windows = cut(_windows(held.join(open_, "h")), "windows")
    twice = windows.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    border = windows.join(twice, "w", "left_semi").select("h", F.col("at").alias("first"), F.col("at").alias("last"))

    ranges = full.union(block).union(border).groupBy("h").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cleaned = _cleaned(held.join(ranges, "h"))
    return rows.join(cleaned, "h", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
