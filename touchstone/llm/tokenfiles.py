"""Token ids in ORC files, in document order.

Texts are range-partitioned and sorted by id, encoded, and written as one ORC file per
partition: ids as integer runs, row indexes on every stride, a Bloom filter on doc_id.
Readers take stripes in parallel and skip stripes and strides whose statistics or filter
exclude an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .common import map_arrow
from .order import ordered

END_ID = 2
#: Distinct words whose ids a Python worker remembers.
WORDS_CACHED = 700_000
#: Words whose ids are gathered in one go.
WORDS_AT_ONCE = 1 << 20
#: Texts are encoded together up to so many bytes, so that words repeat.
BATCH_BYTES = 8 << 20
_SUFFIX = b".,!*&%$#|"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_MARK = "\x01"


class WordIds(dict):
    """Ids per word of a tokenizer whose tokens never cross or hold white space.

    Lower-casing ASCII first is safe for a vocabulary that lower-cases anyway, and a run
    of ASCII punctuation after a letter or digit is a token boundary; both make words
    repeat more often. Whatever these rules do not cover goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        base = word.rstrip(_SUFFIX)
        if base and base != word and base[-1] in _ALNUM:
            out = self[base] + self[word[len(base) :]]
        elif base == word and word.isalpha() and word.isascii():
            out = np.array([t.id for t in self.merge(word.decode())], np.uint32).tobytes()
        else:
            out = self.direct(word.decode())
        self[word] = out
        return out

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Encode unknown words that hold more than ASCII letters together, marks between."""
        bases = {w.rstrip(_SUFFIX) for w in words if not w.isascii()}
        open_ = [w for w in bases if w and not w.isascii() and w not in self]
        if len(self.mark) != 1 or len(open_) < 2 or any(b"\x01" in w for w in open_):
            return
        joined = self.tokenizer.encode(f" {_MARK} ".join(w.decode() for w in open_), add_special_tokens=False)
        ids = np.array(joined.ids, np.uint32)
        parts = np.split(ids, np.flatnonzero(ids == self.mark[0]))
        if len(parts) == len(open_):
            for i, (w, p) in enumerate(zip(open_, parts)):
                self[w] = p[1 if i else 0 :].tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text).

        Words are split and told apart by Arrow; Python sees each distinct word of a batch once.
        """
        if len(self) > WORDS_CACHED:
            self.clear()
        texts = texts.fill_null("")
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        special = pc.match_substring(texts, "<|")  # may hold special tokens, which are told by case
        plain = pc.ascii_lower(pc.if_else(special, "", texts))
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn([w for w in distinct if w not in self])
        ids = [self[w] for w in distinct]
        held, size = np.frombuffer(b"".join(ids), np.uint32), np.array([len(x) // 4 for x in ids], np.int64)
        first = np.cumsum(size) - size
        at = words.indices.to_numpy()
        flat = [held[_ranges(first[part], size[part])] for part in np.split(at, range(WORDS_AT_ONCE, len(at), WORDS_AT_ONCE))]
        ends = np.concatenate([[0], np.cumsum(size[at])])[split.offsets.to_numpy()]
        flat, counts = np.concatenate(flat), np.diff(ends)
        whole = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if len(whole):
            parts = np.split(flat, ends[1:-1])
            for i in whole:
                parts[i] = np.frombuffer(self.direct(texts[int(i)].as_py()), np.uint32)
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, counts


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _gathered(batches):
    """Record batches joined until they hold BATCH_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_LOADED: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The tokenizer of this worker, read once."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, at, n_tokens, ids) in ascending order of doc_id; a null text has the end id only.

    Rows that repeat an id follow each other, by a hash of their text; null ids come first.
    """
    placed = ordered(docs.select("doc_id", "text"), ["doc_id", F.xxhash64("text")])

    def run(batches):
        known = encoder(path)
        for b in _gathered(batches):
            flat, counts = known.encode(b.column("text"))
            flat = pa.array(np.insert(flat, np.cumsum(counts), end_id).view(np.int32), pa.int32())
            ends = np.concatenate([[0], np.cumsum(counts + 1)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("at"), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                ["doc_id", "at", "n_tokens", "ids"])

    return map_arrow(placed, run, "doc_id long, at long, n_tokens int, ids array<int>")


def write(docs: DataFrame, path: str, out: str | None = None, end_id: int = END_ID) -> str:
    """Encode ``docs`` into ORC files under ``out`` (a new shared folder by default)."""
    out = out or new_path(docs.sparkSession, "tokens")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
        "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20), "compression": "zstd",
    }
    encode(docs, path, end_id).write.options(**options).orc(out)
    return out


def read(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; filters on doc_id prune stripes and strides."""
    return spark.read.schema("doc_id long, at long, n_tokens int, ids array<int>").orc(out)


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, at, n_tokens, ids_crc32) from the ids that the files hold."""
    import zlib

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("at"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "at", "n_tokens", "ids_crc32"])

    return map_arrow(files.select("doc_id", "at", "ids"), run, "doc_id long, at long, n_tokens long, ids_crc32 long")
