"""SentencePiece encoding and decoding as a max-plus scan.

The segmentation of a text is the path of pieces with the largest sum of scores: the
library's answer for a unigram model, and for any other model the best path under the
scores in its file. Short texts are solved in one go. A giant text is cut into chunks
with no regard to pieces. A piece may straddle a cut, so a state at a cut is the number
of code points from the cut to the first boundary at or after it. Each chunk yields a
transfer matrix between the states at its two ends; matrices combine associatively in
the (max, +) algebra, in groups of FAN per level; going down again gives every chunk its
states, and each chunk is then traced back by itself.

A model trained by merges is encoded by its merges instead (``merges``). No merge crosses
a word mark, so giant texts are cut at marks there, and need no scan.

No piece holds a word mark after another character, so within a chunk all states meet
at the first word mark, and a word's best path can be remembered.
"""

from __future__ import annotations

import heapq
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import map_arrow, texts_of

CHUNK = 32768
#: Chunks, or groups of chunks, whose matrices one task combines.
FAN = 64
WORDS_CACHED = 800_000
#: A model's word mark; here words begin with a space, and a mark in a text is one too.
SIGN, MARK = "▁", " "
#: What the library takes off the lowest score for a character without a piece.
UNKNOWN = 10.0
NONE = -np.inf
#: Placeholder pieces have scores like -1e9; as large sums lose exactness, this is low enough.
FLOOR = -1e6


def _tie(i: int) -> float:
    """Below 2 ** -8: makes paths of equal scores differ, so that cuts cannot decide between them."""
    return (i * 2654435761 % 2**32 >> 23) / 2**17


class Pieces(dict):
    """Segment to its best ids (as bytes), filled on demand; and the model behind it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        form = lambda i: self.text[i].replace(SIGN, MARK)
        self.score = {form(i): (max(sp.get_score(i), FLOOR) + _tie(i), i) for i in plain}
        self.bytes = {int(self.text[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk = sp.unk_id()
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if sp.is_control(i) else form(i).encode() for i in ids]
        self.value_of = {i: score for score, i in self.score.values()}
        self.longest = max(map(len, self.score))
        self.low = min((score for score, _ in self.score.values()), default=0.0) - UNKNOWN
        # Every beginning of a piece; the value is None where it is no piece itself.
        self.begun = dict.fromkeys(p[:k] for p in self.score for k in range(1, len(p)))
        self.begun.update(self.score)
        # Where words meet no piece may span, or they cannot be solved apart.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.score)
        # Signs that no piece holds after a letter or digit: a boundary lies before them.
        after = {y for p in self.score for x, y in zip(p, p[1:]) if x.isalnum()}
        self.signs = "".join(c for c in ".,;:!?*&%$#|()\"=" if c not in after)
        self.prefix = sp.encode("a", out_type=str)[0].startswith(SIGN)

    def normal(self, text: str) -> str:
        """Every mark a space, with one space before a text that is not empty."""
        return ((MARK if self.prefix else "") + text.replace(SIGN, MARK)) if text else ""

    def steps(self, s: str, at: int, stop: int) -> list[tuple[int, float, int | None]]:
        """(end, score, id) of the pieces of ``s`` that begin at ``at`` and end by ``stop``."""
        out, begun = [], self.begun
        for end in range(at + 1, min(stop, at + self.longest) + 1):
            part = s[at:end]
            if part not in begun:
                break
            found = begun[part]
            if found:
                out.append((end, *found))
        if at < stop and not (out and out[0][0] == at + 1):
            out.append((at + 1, self.low, None))
        return out

    def path(self, s: str) -> list[int]:
        """Ids along the best path over all of ``s``; of equal paths, the one whose pieces begin first."""
        n, longest, begun = len(s), self.longest, self.begun
        best, back = [NONE] * (n + 1), [0] * (n + 1)
        name: list[int | None] = [None] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            base, one = best[at], True
            for end in range(at + 1, min(n, at + longest) + 1):
                part = s[at:end]
                if part not in begun:
                    break
                found = begun[part]
                if found:
                    if end == at + 1:
                        one = False
                    if base + found[0] > best[end]:
                        best[end], back[end], name[end] = base + found[0], at, found[1]
            if one and base + self.low > best[at + 1]:
                best[at + 1], back[at + 1], name[at + 1] = base + self.low, at, None
        out, end = [], n
        while end:
            at, i = back[end], name[end]
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(s[at:end].encode())]
            else:
                out.append(self.unk)
            end = at
        return out[::-1]

    def value(self, s: str) -> float:
        """The score of the best path over ``s``."""
        best = np.full(len(s) + 1, NONE)
        best[0] = 0.0
        for at in range(len(s)):
            for end, score, _ in self.steps(s, at, len(s)):
                best[end] = max(best[end], best[at] + score)
        return float(best[-1])

    def __missing__(self, segment: str) -> bytes:
        base = segment.rstrip(self.signs)
        if base != segment and base and base[-1].isalnum():
            out = self[base] + self[segment[len(base) :]]
        else:
            out = np.array(self.path(segment), np.int32).tobytes()
        if len(segment) <= 64:
            if len(self) >= WORDS_CACHED:
                self.clear()
            self[segment] = out
        return out

    def segments(self, s: str) -> list[str]:
        """``s`` cut before every run of marks, and around line ends if they have no piece."""
        if not self.apart:
            return [s]
        if MARK + MARK in s or "\0" in s:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", s)
        s = s.replace(MARK, "\0" + MARK)
        if "\n" not in self.begun:
            s = s.replace("\n", "\0\n\0")
        return [x for x in s.split("\0") if x]

    def encode(self, s: str) -> np.ndarray:
        """Ids of a normal form."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.segments(s))), np.int32)

    def decode(self, ids) -> str:
        """The text of ids: bytes join to characters, marks are spaces, the first is dropped."""
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(MARK) else s

    def matrix(self, s: str, size: int, last: bool) -> np.ndarray:
        """Best scores from each state at the chunk's begin to each at its end.

        ``s`` holds the chunk's ``size`` characters and those that a straddling piece may
        add. Pieces that begin in the chunk are its own. Cuts before marks (not the first
        run of characters) let the inside be solved once for all states.
        """
        width = self.longest
        inside = [m.start() for m in re.finditer(f"(?<!{MARK}){MARK}", s[:size]) if m.start() >= width] if self.apart else []
        if len(inside) < 2 or inside[-1] <= inside[0]:
            return self._matrix(s, size, width, last)
        a, z = inside[0], inside[-1]
        head = self._matrix(s[:a], a, width, True)[:, 0]
        middle = sum(map(self._word, self.segments(s[a:z])))
        tail = self._matrix(s[z:], size - z, width, last)[0]
        return head[:, None] + middle + tail[None, :]

    def _word(self, segment: str) -> float:
        ids = np.frombuffer(self[segment], np.int32).tolist()
        # Characters without a piece cost the same however many bytes they take.
        if self.byte_of.keys().isdisjoint(ids) and self.unk not in ids:
            return sum(self.value_of[i] for i in ids)
        return self.value(segment)

    def _matrix(self, s: str, size: int, width: int, last: bool) -> np.ndarray:
        best = np.full((size + width + 1, width), NONE)
        for i in range(min(width, size + width)):
            best[i, i] = 0.0
        for at in range(size):
            for end, score, _ in self.steps(s, at, len(s)):
                np.maximum(best[end], best[at] + score, out=best[end])
        out = best[size : size + width].T.copy()
        if last:
            out[:, 1:] = NONE
        return out


class Merges(Pieces):
    """The encoding of a merge model: the adjacent parts whose join scores best are joined first, the leftmost of equals."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(path)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {p: -sp.get_score(i) for p, (_, i) in self.score.items()}

    def path(self, s: str) -> list[int]:
        n, rank, parts, heap = len(s), self.rank, list(s), []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, j, len(whole)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        out = []
        for part in filter(None, parts):
            if part in self.score:
                out.append(self.score[part][1])
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode()]
            else:
                out.append(self.unk)
        return out

    def cuts(self, s: str, chunk: int) -> list[int]:
        """Ends of parts of about ``chunk`` characters that no merge crosses; a longer word stays whole."""
        ends = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", s)] if self.apart else []
        out = [0]
        for here, following in zip(ends, [*ends[1:], len(s)]):
            if following - out[-1] > chunk:
                out.append(here)
        return [*out[1:], len(s)]


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, merges: bool = False) -> Pieces:
    """The model of a file; with ``merges``, one that encodes by merges if the file's model does."""
    if (path, merges) not in _LOADED:
        _LOADED[path, merges] = Merges(path) if merges and merged(path) else Pieces(path)
    return _LOADED[path, merges]


def merged(path: str) -> bool:
    """Whether the file holds a merge model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type == pb.TrainerSpec.BPE


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _square(raw: bytes) -> np.ndarray:
    m = np.frombuffer(raw, np.float64)
    return m.reshape(int(np.sqrt(len(m))), -1)


def _combine(pdf):
    pdf = pdf.sort_values("idx")
    m = _square(pdf["m"].iloc[0])
    for raw in pdf["m"].iloc[1:]:
        m = times(m, _square(raw))
    return pdf.head(1).assign(idx=pdf["g"].iloc[0], m=m.tobytes())[["doc_id", "h", "idx", "m"]]


def _resolve(pdf):
    """States between the members of a group, from those at its two ends; ties go to the nearer boundary."""
    pdf = pdf.sort_values("idx").reset_index(drop=True)
    mats = [_square(r) for r in pdf["m"]]
    first, last = int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0])
    reach = [np.where(np.arange(len(mats[0])) == first, 0.0, NONE)]
    for m in mats:
        reach.append((reach[-1][:, None] + m).max(0))
    states = [last]
    for k in range(len(mats) - 1, -1, -1):
        states.append(int(np.argmax(reach[k] + mats[k][:, states[-1]])))
    states = states[::-1]
    return pdf.assign(first=states[:-1], last=states[1:])[["doc_id", "h", "idx", "first", "last"]]


def states(matrices: DataFrame) -> DataFrame:
    """(doc_id, h, idx, first, last): the states at both ends of every chunk.

    Matrices are combined FAN at a time, level by level, and levels are resolved downwards.
    """
    levels = [matrices]
    while (levels[-1].agg(F.max("idx")).collect()[0][0] or 0) >= FAN:
        up = levels[-1].withColumn("g", F.floor(F.col("idx") / FAN)).groupBy("doc_id", "h", "g")
        levels.append(cut(up.applyInPandas(_combine, "doc_id long, h long, idx long, m binary"), "matrices"))
    known = levels[-1].select("doc_id", "h", F.lit(0).cast("long").alias("g")).distinct().withColumns({"first": F.lit(0), "last": F.lit(0)})
    for level in reversed(levels):
        inner = level.withColumn("g", F.floor(F.col("idx") / FAN)).join(known, ["doc_id", "h", "g"])
        solved = inner.groupBy("doc_id", "h", "g").applyInPandas(_resolve, "doc_id long, h long, idx long, first int, last int")
        known = cut(solved, "states").withColumnRenamed("idx", "g")
    return known.withColumnRenamed("g", "idx")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _key(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64))


_TOKENS = "doc_id long, h long, n_chars long, ids array<int>"


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def _short(path: str, merges: bool, batches):
    model = pieces(path, merges)
    for b in batches:
        texts = texts_of(b)
        ids = [model.encode(model.normal(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([_key(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), _lists(ids)],
            ["doc_id", "h", "n_chars", "ids"])


def _chunks(path: str, chunk: int, batches):
    """(doc_id, h, idx, text, size, last, m): the pieces of giant texts with their matrices."""
    model = pieces(path)
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
            h, s = _key(t), model.normal(t)
            for idx, at in enumerate(range(0, len(s), chunk)):
                part, last = s[at : at + chunk + model.longest], at + chunk >= len(s)
                size = min(chunk, len(s) - at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([h]), pa.array([idx]), pa.array([part]), pa.array([size], pa.int32()), pa.array([model.matrix(part, size, last).tobytes()], pa.binary())],
                    ["doc_id", "h", "idx", "part", "size", "m"])


def _words(path: str, chunk: int, batches):
    """(doc_id, h, idx, part, size, first, last): the parts of giant texts, cut where no merge crosses."""
    model = pieces(path, True)
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
            h, s, at = _key(t), model.normal(t), 0
            for idx, end in enumerate(model.cuts(s, chunk)):
                size, none = pa.array([end - at], pa.int32()), pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([h]), pa.array([idx]), pa.array([s[at:end]]), size, none, none], ["doc_id", "h", "idx", "part", "size", "first", "last"])
                at = end


def _traced(path: str, merges: bool, batches):
    model = pieces(path, merges)
    for b in batches:
        rows = zip(b.column("part").to_pylist(), b.column("size").to_pylist(), b.column("first").to_pylist(), b.column("last").to_pylist())
        ids = [model.encode(p[f : n + z]) if n + z > f else np.empty(0, np.int32) for p, n, f, z in rows]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("idx"), _lists(ids)], ["doc_id", "h", "idx", "ids"])


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, merges: bool = False) -> DataFrame:
    """(doc_id, h, n_chars, ids) for every row; ``h`` is Spark's hash of the text.

    With ``merges``, a merge model is encoded as the library does, by its merges;
    otherwise the ids are the best path under the scores.

    Null and empty texts have no ids; repeated rows are all kept. Texts
    of at most ``chunk`` characters are one chunk, whose states are known; the others take
    the scan. Other columns take no part.
    """
    docs = docs.select("doc_id", "text")
    short = map_arrow(docs.where(f"text IS NULL OR length(text) < {chunk}"), partial(_short, path, merges), _TOKENS)
    giant = docs.where(f"length(text) >= {chunk}")
    named, columns = giant.where("doc_id IS NOT NULL"), "doc_id long, h long, idx long, part string, size int"
    if merges and merged(path):
        known = map_arrow(named, partial(_words, path, chunk), f"{columns}, first int, last int").dropDuplicates(["doc_id", "h", "idx"])
    else:
        chunks = cut(map_arrow(named, partial(_chunks, path, chunk), f"{columns}, m binary").dropDuplicates(["doc_id", "h", "idx"]), "chunks")
        known = chunks.drop("m").join(states(chunks.select("doc_id", "h", "idx", "m")), ["doc_id", "h", "idx"])
    traced = map_arrow(known, partial(_traced, path, merges), "doc_id long, h long, idx long, ids array<int>")
    whole = traced.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("idx", "ids"))).alias("parts"))
    whole = whole.select("doc_id", "h", F.flatten(F.col("parts.ids")).alias("ids"))
    rows = giant.select("doc_id", text_key().alias("h"), F.length("text").cast("long").alias("n_chars"))
    long_ = rows.join(whole, ["doc_id", "h"]).select("doc_id", "h", "n_chars", "ids")
    # A row without an id cannot be named in the scan; such texts are solved in one go.
    nameless = map_arrow(giant.where("doc_id IS NULL"), partial(_short, path, merges), _TOKENS)
    return short.union(long_).union(nameless)


def decode(tokens: DataFrame, path: str, out: str = "text") -> DataFrame:
    """Add the text of ``ids`` to every row."""
    kept = [k for k in tokens.columns if k != out]

    def run(batches):
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array([model.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], [*kept, out])

    return map_arrow(tokens.select(*kept), run, tokens.select(*kept).withColumn(out, F.lit("")).schema)


def with_round_trip(tokens: DataFrame, path: str) -> DataFrame:
    """Add n_tokens, ids_crc32 and round_trip: whether the decoded text is the encoded one.

    It is for every text without the word mark itself (U+2581), which decodes to a space.
    """
    import zlib

    def run(batches):
        model = pieces(path)
        for b in batches:
            lists = b.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<i4")
            ends = lists.offsets.to_numpy()
            ids = [flat[a:z] for a, z in zip(ends[:-1], ends[1:])]
            same = [_key(model.decode(x.tolist())) == h for x, h in zip(ids, b.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_chars"), pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same), lists],
                ["doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip", "ids"])

    return map_arrow(tokens, run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean, ids array<int>")
