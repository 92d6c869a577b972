"""Chat formatting: conversations become one marked string each, with a loss mask.

Bytes are assembled by column. From the lengths of a batch's headers and texts come
cumulative offsets and, for every source byte, its place in one preallocated Arrow
buffer; headers and texts are then scattered there in numpy. No string is built per turn.

A turn is written as ``<|turn|>role<|says|>text<|end|>``. Where a role or text holds a
control string, a backslash goes after that string's first character, and a backslash of
its own is doubled, so that no text can open or close a turn and all can be read back.
The loss mask is a list of spans of code points: the escaped texts of assistants.

Rows are range-partitioned by conversation and turn, so a conversation of any length is
dealt over many tasks. It is stored in pieces of bounded size, in order. Only those pieces
of a conversation that lie in more than one place are brought together to be read; a
digest of one conversation is sequential by nature and streams through them.

Odd rows: a null text or role counts as empty. Rows without conv_id form one conversation
without an id; turns that are null come first. Repeated rows are turns of their own; where
turns tie, rows go by role and then by a hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: Bytes of source text that are assembled at once; a longer single text is handled alone.
BATCH_BYTES = 8 << 20
#: Bytes for which places are held at once while they are copied.
STEP = 1 << 20
BACKSLASH = 92

SCHEMA = "conv_id long, part long, whole boolean, n_turns int, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the role that is trained on, and further strings that texts must not contain as they are."""

    start: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    learn: str = "assistant"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self):
        marks = (self.start, self.says, self.end)
        for c in self.controls:
            if len(c) < 2 or not c.isascii() or "\\" in c:
                raise ValueError(f"a control string has two ASCII characters at least and no backslash: {c!r}")
        if any(m[0] in c[1:] for m in marks for c in marks):
            raise ValueError("a mark must not begin inside another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.says, self.end, *self.others)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def marks(data: np.ndarray, ends: np.ndarray, strings) -> np.ndarray:
    """Places where one of ``strings`` begins and lies within a row, in order."""
    found = [np.zeros(0, np.int64)]
    for first in {s[0] for s in strings}:
        places = np.flatnonzero(data == ord(first))
        for s in (x.encode() for x in strings if x[0] == first):
            at = places[places <= len(data) - len(s)]
            for j in range(1, len(s)):
                at = at[data[at + j] == s[j]]
            found.append(at[at + len(s) <= ends[np.searchsorted(ends, at, "right")]])
    return np.unique(np.concatenate(found))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of small ``values`` in each row, without a wider copy of them."""
    out = np.zeros(len(ends) - 1, np.int64)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if len(some):
        out[some] = np.add.reduceat(values.view(np.uint8), ends[:-1][some], dtype=np.int64)
    return out


def leads(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


def breaks(data: np.ndarray, ends: np.ndarray, controls) -> np.ndarray:
    """Places before which an escape puts a backslash: each backslash, and the second character of a control string."""
    return np.sort(np.concatenate([np.flatnonzero(data == BACKSLASH), marks(data, ends, controls) + 1]))


class Column:
    """Roles or texts of a batch, with what escaping adds to each row."""

    def __init__(self, column: pa.Array, controls):
        self.data, self.ends = flat(column)
        self.breaks = breaks(self.data, self.ends, controls)
        self.before = np.searchsorted(self.breaks, self.ends)
        extra = np.diff(self.before)
        self.bytes = np.diff(self.ends) + extra
        self.chars = sums(leads(self.data), self.ends) + extra

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Copy row i to ``out`` from ``starts[i]`` on; the scatter indices of STEP bytes are held at a time."""
        move = starts - self.ends[:-1] - self.before[:-1]
        for a in range(0, len(self.data), STEP):
            b = min(a + STEP, len(self.data))
            rows = np.searchsorted(self.ends, [a, b - 1], "right") - 1
            inside = np.diff(np.clip(self.ends[rows[0] : rows[1] + 2], a, b))
            here = self.breaks[np.searchsorted(self.breaks, a) : np.searchsorted(self.breaks, b)]
            more = np.bincount(here - a, minlength=b - a).cumsum() + np.searchsorted(self.breaks, a)
            to = np.arange(a, b) + np.repeat(move[rows[0] : rows[1] + 1], inside) + more
            out[to] = self.data[a:b]
            out[to[here - a] - 1] = BACKSLASH


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, t: Template) -> tuple[pa.Array, pa.Array]:
    """(formatted, loss) of the pieces that begin at rows ``first``: one buffer for all of them."""
    n = len(texts)
    role, text = Column(roles, t.controls), Column(texts, t.controls)
    fixed = [s.encode() for s in (t.start, t.says, t.end)]
    widths = np.column_stack([np.full(n, len(fixed[0])), role.bytes, np.full(n, len(fixed[1])), text.bytes, np.full(n, len(fixed[2]))])
    ends = np.concatenate([[0], widths.ravel().cumsum()])
    places = ends[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, s in zip((0, 2, 4), fixed):
        out[places[:, k, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
    role.scatter(out, places[:, 1])
    text.scatter(out, places[:, 3])
    cuts = np.concatenate([places[first, 0], ends[-1:]]).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), buffer)

    # Marks are ASCII, so that only roles and texts differ in bytes and code points.
    chars = sum(map(len, fixed)) + role.chars + text.chars
    row_at = np.concatenate([[0], chars.cumsum()])
    piece = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    begin = row_at[:-1] - row_at[first][piece] + len(fixed[0]) + role.chars + len(fixed[1])
    learn = np.flatnonzero(pc.equal(roles, t.learn).fill_null(False).to_numpy(zero_copy_only=False))
    spans = pa.StructArray.from_arrays([pa.array(begin[learn]), pa.array((begin + text.chars)[learn])], ["start", "end"])
    bounds = np.searchsorted(learn, np.append(first, n)).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)


def _slices(batch: pa.RecordBatch, columns: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64) for c in columns)
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _bytes(batch: pa.RecordBatch) -> int:
    return sum(pc.sum(pc.binary_length(batch.column(c))).as_py() or 0 for c in ("role", "text"))


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Rows where a conversation begins."""
    ids = batch.column("conv_id")
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))


def _pieces(batches: Iterator[pa.RecordBatch], template: Template, most: int) -> Iterator[pa.RecordBatch]:
    """Formatted pieces of a partition of sorted rows.

    The last conversation of a slice waits for the next one. The first and the last of a
    partition may go on in others, so that they are never marked whole.
    """
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    held, cut_id, begun = None, None, False  # cut_id: (id,) of a conversation that was cut

    def emit(rows: pa.RecordBatch, final: bool):
        nonlocal at, begun, cut_id
        first = _runs(rows)
        ids = rows.column("conv_id").take(pa.array(first))
        whole = np.ones(len(first), bool)
        if not begun or cut_id == (ids[0].as_py(),):
            whole[0] = False
        if final:
            whole[-1] = False
        begun, cut_id = True, (ids[-1].as_py(),) if final else None
        formatted, loss = assemble(rows.column("role"), rows.column("text"), first, template)
        turns = np.diff(np.append(first, rows.num_rows)).astype(np.int32)
        columns = [ids, pa.array(at + np.arange(len(first))), pa.array(whole), pa.array(turns), formatted, loss]
        at += len(first)
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "whole", "n_turns", "formatted", "loss"])

    for batch in batches:
        for part in _slices(batch, ("role", "text"), most):
            rows = part if held is None else pa.concat_batches([held, part])
            last = int(_runs(rows)[-1])
            held = rows.slice(last)
            if last:
                yield emit(rows.slice(0, last), False)
            if _bytes(held) > most:
                yield emit(held, True)
                held = None
    if held is not None:
        yield emit(held, True)


def format_chats(conversations: DataFrame, template: Template = Template(), most: int = BATCH_BYTES) -> DataFrame:
    """(conv_id, part, whole, n_turns, formatted, loss): conversations in pieces that follow one another by ``part``.

    Spans of ``loss`` are code points of their own piece. A piece that is not ``whole``
    may have others of the same conversation.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", F.xxhash64("text").alias("tie"))
    # Range bounds are sampled to the driver; a hash stands in for texts there.
    by = ["conv_id", "turn", "role", "tie"]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("conv_id", "role", "text")
    return placed.mapInArrow(lambda batches: _pieces(batches, template, most), SCHEMA)


def write(conversations: DataFrame, path: str | None = None, template: Template = Template(), most: int = BATCH_BYTES) -> str:
    """Store formatted conversations as Parquet; returns the path."""
    path = path or new_path(conversations.sparkSession, "chats")
    format_chats(conversations, template, most).write.mode("overwrite").parquet(path)
    return path


def _bytes_at(data: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Byte places of code points, given in rising order."""
    out, seen, done = np.full(len(chars), len(data)), 0, 0
    for a in range(0, len(data), STEP):
        lead = np.flatnonzero(leads(data[a : a + STEP]))
        upto = np.searchsorted(chars, seen + len(lead))
        out[done:upto] = a + lead[chars[done:upto] - seen]
        done, seen = upto, seen + len(lead)
    return out


def decode(batch: pa.RecordBatch, t: Template) -> dict[str, np.ndarray]:
    """What formatted pieces hold: their turns as role, newline, text, newline; the bytes under the mask; counts.

    Only the formatted string and its spans are read.
    """
    data, ends = flat(batch.column("formatted"))
    n = len(ends) - 1
    lead = leads(data)
    chars = sums(lead, ends)

    # Within a run of backslashes each second one is text; a single one is an escape.
    slashes = np.flatnonzero(data == BACKSLASH)
    new = np.diff(slashes, prepend=-2) != 1
    order = np.arange(len(slashes))
    keep = np.ones(len(data), bool)
    keep[slashes[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 0]] = False

    loss = batch.column("loss")
    per_piece = np.diff(loss.offsets.to_numpy())
    spans = loss.flatten()
    base = np.repeat(np.concatenate([[0], chars.cumsum()])[:-1], per_piece)
    borders = np.column_stack([spans.field(k).to_numpy(zero_copy_only=False) + base for k in (0, 1)]).ravel() if len(spans) else np.zeros(0, np.int64)
    at = _bytes_at(data, borders)
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, at[0::2], 1)
    np.add.at(step, at[1::2], -1)
    masked = keep & step[:-1].cumsum(dtype=np.int8).astype(bool)

    opened = marks(data, ends, [t.start])
    turns = data.copy()
    keep[opened[:, None] + np.arange(len(t.start))] = False
    for s in (t.says, t.end):
        found = marks(data, ends, [s])
        turns[found] = ord("\n")
        keep[found[:, None] + np.arange(1, len(s))] = False
    counted = lambda kept: np.concatenate([[0], sums(kept, ends).cumsum()])
    return {
        "turns": turns[keep], "turn_ends": counted(keep), "loss": data[masked], "loss_ends": counted(masked), "chars": chars,
        "loss_chars": sums(masked & lead, ends), "n_turns": np.diff(np.searchsorted(opened, ends)) if n else np.zeros(0, np.int64),
    }


def _digests(batches: Iterator[pa.RecordBatch], t: Template) -> Iterator[pa.RecordBatch]:
    """One row per conversation from pieces in order; of a long one, one piece is held at a time."""
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    now, done = None, []

    def close():
        _, turns, loss, n, loss_chars, chars = now
        done.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in k else pa.int64()) for k, c in zip(names, zip(*done))], names)
        done.clear()
        return out

    for batch in (part for whole in batches for part in _slices(whole, ("formatted",), BATCH_BYTES)):
        got = decode(batch, t)
        turns, loss = memoryview(got["turns"]), memoryview(got["loss"])
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            now[1].update(turns[got["turn_ends"][i] : got["turn_ends"][i + 1]])
            now[2].update(loss[got["loss_ends"][i] : got["loss_ends"][i + 1]])
            for k, name in ((3, "n_turns"), (4, "loss_chars"), (5, "chars")):
                now[k] += int(got[name][i])
        if done:
            yield flush()
    if now is not None:
        close()
        yield flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def digests(stored: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests of each conversation, read back from what ``write`` stored.

    Conversations that lie whole in one piece are read where they are; only pieces of the
    others are shuffled.
    """
    fold = lambda df: df.select("conv_id", "formatted", "loss").mapInArrow(lambda b: _digests(b, template), DIGESTS)
    parts = stored.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return fold(stored.where("whole")).unionByName(fold(parts))
