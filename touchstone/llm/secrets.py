"""Secret scans: exact rules, and a character network over every further candidate.

Rules find assigned values, access keys and hex runs. Any other long run of key-like
characters with a letter is a candidate, unless a rule's finding covers it whole; a small
convolutional network in numpy reads the run with its surroundings, and a long run also in
sliding windows, of which the highest probability counts. It is trained on all findings that the rules label, calibrated on
all findings of other documents, and its threshold keeps the wanted recall there with as few
harmless findings as that allows.

Training rows are dealt by a hash into blocks of about ``BLOCK``. In each round every block
takes one pass of Adam from the shared state, and the mean of the blocks' states is the next
one. States are added up as integers, so the mean does not hang on the order of tasks.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import logistic, map_arrow, newton, texts_of

#: The rules, their least lengths, and their order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "net")

#: Training rows of a block, of a step, and rounds; the network's shape.
BLOCK, STEP, EPOCHS = 4096, 128, 12
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH, FILTERS = 5, 16
LEAST_RUN = 16
RECALL = 0.98

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
_LETTER, _SIGN = re.compile(r"[A-Za-z]"), re.compile(r"[A-Za-z0-9]")
_WORDS = re.compile(r"[A-Za-z]{12,}")

#: Fixed point of states that are added up, and bins that narrow down an order statistic.
POINT, BINS = 2.0**40, 4096

#: Character classes: the key-like ones by themselves, all else in a few groups.
_OWN = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-.:\"' \n"
PAD, OTHER, CLASSES = 0, 1, len(_OWN) + 3


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER)
    for i, ch in enumerate(_OWN):
        table[ord(ch)] = i + 3
        table[ord(ch.upper())] = i + 3
    return table.astype(np.int16)


_CLASS = _class_table()


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings in code points, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, plain: bool = False) -> list[tuple[int, int]]:
    """Maximal runs of key-like characters that are long enough and hold a letter.

    With ``plain``, runs of digits alone count too.
    """
    return [m.span() for m in _RUN.finditer(text) if (_SIGN if plain else _LETTER).search(m[0])]


def views(start: int, end: int) -> list[tuple[int, int]]:
    """What the network reads of a run: all of it, and of a long run also windows that overlap by half."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(start, end), *((a, a + INSIDE) for a in range(start, end - INSIDE, INSIDE // 2)), (end - INSIDE, end)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes around and inside a run; of a long run, its two ends."""
    body = text[start:end] if end - start <= INSIDE else text[start : start + INSIDE // 2] + text[end - INSIDE // 2 : end]
    parts = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), body.ljust(INSIDE, "\0"), text[end : end + AFTER].ljust(AFTER, "\0"))
    raw = np.frombuffer("".join(parts).encode("latin-1", "replace"), np.uint8)
    return np.where(raw == 0, PAD, _CLASS[raw]).astype(np.int16)


def shape(text: str, start: int, end: int) -> list[float]:
    """What pooling loses: entropy, digits, case."""
    run = text[start:end]
    counts = np.bincount(np.frombuffer(run.encode(), np.uint8))
    p = counts[counts > 0] / len(run)
    upper = sum(c.isupper() for c in run)
    return [float(-(p * np.log2(p)).sum()) / 5, sum(c.isdigit() for c in run) / len(run), min(upper, len(run) - upper) / len(run), min(len(run), 64) / 64]


@dataclass
class Net:
    kernel: np.ndarray  # (WIDTH, CLASSES, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # max and mean of each filter, then shape, then 1
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = x.shape[1] - WIDTH + 1
        h = self.bias + sum(self.kernel[i][x[:, i : i + size]] for i in range(WIDTH))
        return np.maximum(h, 0), h

    def logits(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        h, _ = self.pooled(x)
        return np.hstack([h.max(1), h.mean(1), extra, np.ones((len(x), 1))]) @ self.dense

    def probability(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x, extra) + b, -35, 35)))


def network(flat: np.ndarray) -> Net:
    """A network on views of its parameters in one row."""
    a, b = WIDTH * CLASSES * FILTERS, WIDTH * CLASSES * FILTERS + FILTERS
    return Net(flat[:a].reshape(WIDTH, CLASSES, FILTERS), flat[a:b], flat[b:])


def begin(rng: np.random.Generator) -> np.ndarray:
    """Random parameters, both moments of Adam and its number of steps, in one row."""
    flat = np.concatenate([rng.normal(0, 0.1, WIDTH * CLASSES * FILTERS), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 5)])
    return np.concatenate([flat, np.zeros(2 * len(flat) + 1)])


def parameters(state: np.ndarray) -> np.ndarray:
    return state[: len(state) // 3]


def balanced(share: float) -> tuple[float, float]:
    """Weights of labels 0 and 1, of which 1 has this share."""
    return 0.5 / (1 - share), 0.5 / share


def descend(state: np.ndarray, x: np.ndarray, extra: np.ndarray, y: np.ndarray, weights: tuple[float, float], order: np.ndarray) -> np.ndarray:
    """The state after one pass of Adam over the rows in ``order``."""
    state = state.copy()
    p, m, v = np.split(state[:-1], 3)
    net = network(p)
    filters = np.arange(FILTERS)
    for part in np.array_split(order, max(1, len(order) // STEP)):
        xb, rows = x[part], np.arange(len(part))[:, None]
        h, raw = net.pooled(xb)
        top, size = h.argmax(1), h.shape[1]
        z = np.hstack([h.max(1), h.mean(1), extra[part], np.ones((len(part), 1))])
        g = np.where(y[part] == 1, weights[1], weights[0]) * (1 / (1 + np.exp(-np.clip(z @ net.dense, -35, 35))) - y[part]) / len(part)
        back = (raw > 0) * (g[:, None] * net.dense[FILTERS : 2 * FILTERS] / size)[:, None, :]
        back[rows, top, filters] += g[:, None] * net.dense[:FILTERS] * (raw[rows, top, filters] > 0)
        flat = np.ascontiguousarray(back.reshape(-1, FILTERS).T)
        kernel = np.empty((WIDTH, CLASSES, FILTERS))
        for i in range(WIDTH):
            classes = xb[:, i : i + size].ravel().astype(np.intp)
            for f in range(FILTERS):
                kernel[i, :, f] = np.bincount(classes, flat[f], CLASSES)
        grad = np.concatenate([kernel.ravel(), flat.sum(1), z.T @ g + 1e-4 * net.dense])
        state[-1] += 1
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        p -= 0.01 * (m / (1 - 0.9 ** state[-1])) / (np.sqrt(v / (1 - 0.999 ** state[-1])) + 1e-8)
    return state


def calibrated(net: Net, scale: np.ndarray, high: float, below: float | None) -> Net:
    """Set scale and threshold. ``high`` is the logit that keeps the recall, ``below`` the highest harmless one under it.

    Harmless findings below leave a gap; its middle keeps the recall as well.
    """
    net.scale = (max(float(scale[0]), 1e-3), float(scale[1]))
    middle = high if below is None else (high + below) / 2
    net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale[0] * middle + net.scale[1], -35, 35))))
    return net


def fit(x: np.ndarray, extra: np.ndarray, y: np.ndarray, check: np.ndarray, recall: float = RECALL, epochs: int = EPOCHS, seed: int = 3) -> Net:
    """Train on rows outside ``check``, calibrate and set the threshold on those inside; for rows at hand.

    Without both classes on either side the network finds nothing: its threshold is
    beyond any probability.
    """
    rng = np.random.default_rng(seed)
    state = begin(rng)
    if any(len(set(y[side])) < 2 for side in (check, ~check)):
        return network(parameters(state))
    xs, es, ys = x[~check], extra[~check], y[~check].astype(float)
    for _ in range(epochs):
        state = descend(state, xs, es, ys, balanced(ys.mean()), rng.permutation(len(xs)))
    net = network(parameters(state))
    held = net.logits(x[check], extra[check])
    scale = logistic(np.stack([held, np.ones_like(held)], 1), y[check].astype(float), l2=1e-2)
    good = np.sort(held[y[check] == 1])
    high = good[int(np.floor((1 - recall) * len(good)))]
    below = held[(y[check] == 0) & (held < high)]
    return calibrated(net, scale, high, below.max() if len(below) else None)


def findings(docs: DataFrame) -> DataFrame:
    """Training rows of every document, equal ones as one: x, extra (bytes), y, check and their number n.

    A run with letters that a rule finds is labelled a secret, and comes again
    without its surroundings and in the other case, so that the network does not only
    learn the rule's keyword. All other runs, runs of digits alone and the first long word of
    every document that no rule touches are labelled harmless. Every fourth document calibrates;
    without an id, its text decides.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                check = bool((np.array([zlib.crc32(t.encode()) if i is None else i], np.int64) * 2654435761 >> 7)[0] % 4 == 0)
                found = [(s, e) for s, k, e in rule_spans(t)]
                add = lambda t, a, z, y: rows.append((window(t, a, z).astype(np.uint8).tobytes(), np.array(shape(t, a, z)).tobytes(), y, check))  # noqa: B023, E731
                for s, e in candidates(t, plain=True):
                    bad = any(a < e and s < z for a, z in found) and any(c.isalpha() for c in t[s:e])
                    for a, z in views(s, e):
                        add(t, a, z, int(bad))
                    if bad:
                        add(t[s:e], 0, e - s, 1)
                        add(t[s:e].swapcase(), 0, e - s, 1)
                word = next((m.span() for m in _WORDS.finditer(t) if not any(a < m.end() and m.start() < z for a, z in found)), None)
                if word:
                    add(t, *word, 0)
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.bool_()))], ["x", "extra", "y", "check"])

    found = map_arrow(docs.select("doc_id", "text"), run, "x binary, extra binary, y int, check boolean")
    return found.groupBy("x", "extra", "y", "check").agg(F.count(F.lit(1)).alias("n"))


def arrays(x: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, np.uint8).reshape(-1, BEFORE + INSIDE + AFTER), np.frombuffer(extra).reshape(-1, 4)


def blocks(rows: DataFrame, n: int, tasks: int) -> DataFrame:
    """Rows dealt by a hash into ``n`` blocks, one row each. Copies come ``n`` times and are dealt by their number as well."""
    copies = rows.select("x", "extra", "y", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    dealt = copies.withColumn("h", F.xxhash64("x", "extra", "y", "copy")).withColumn("block", F.pmod("h", F.lit(n)))

    def pack(key, t):
        t = t.sort_by([("h", "ascending"), ("copy", "ascending")])
        x, extra = (b"".join(t.column(k).to_pylist()) for k in ("x", "extra"))
        y = t.column("y").to_numpy().astype(np.uint8).tobytes()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *[pa.array([k], pa.binary()) for k in (x, extra, y)]], ["block", "x", "extra", "y"])

    return dealt.repartition(min(n, max(tasks, n // 16)), "block").groupBy("block").applyInArrow(pack, "block long, x binary, extra binary, y binary")


def advance(dealt: DataFrame, state: np.ndarray, weights: tuple[float, float], seed: int, epoch: int) -> np.ndarray:
    """The mean of the states that the blocks reach from ``state`` in one pass; each task returns one sum."""

    def run(batches):
        total, n = np.zeros(len(state), np.int64), 0
        for b in batches:
            for row in range(b.num_rows):
                block, x, extra, y = (b.column(k)[row].as_py() for k in ("block", "x", "extra", "y"))
                y = np.frombuffer(y, np.uint8)
                order = np.random.default_rng([seed, epoch, block]).permutation(len(y))
                total += np.rint(descend(state, *arrays(x, extra), y, weights, order) * POINT).astype(np.int64)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["total", "n"])

    sums = map_arrow(dealt, run, "total binary, n long").collect()
    return sum(np.frombuffer(r["total"], np.int64) for r in sums) / POINT / sum(r["n"] for r in sums)


def logits(rows: DataFrame, net: Net) -> DataFrame:
    """(z, y, n): the network's logit for each row of ``findings``."""

    def run(batches):
        for b in batches:
            z = net.logits(*arrays(*(b"".join(b.column(k).to_pylist()) for k in ("x", "extra"))))
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), b.column("y"), b.column("n")], ["z", "y", "n"])

    return map_arrow(rows.select("x", "extra", "y", "n"), run, "z double, y int, n long")


def at_rank(rows: DataFrame, rank: int) -> float:
    """The value z at a 0-based rank among rows that count n times each, by ever narrower bins."""
    lo, hi = rows.agg(F.min("z"), F.max("z")).first()
    while lo < hi:
        bin_ = F.least(F.floor((F.col("z") - lo) / ((hi - lo) / BINS)), F.lit(BINS - 1))
        found = rows.where(F.col("z").between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))
        for r in sorted(found.collect()):
            lo, hi = r["lo"], r["hi"]
            if rank < r["n"]:
                break
            rank -= r["n"]
    return lo


def calibrate(net: Net, held: DataFrame, recall: float = RECALL) -> Net:
    """Scale and threshold from all rows of ``held`` (z, y, n), both labels present."""

    def sums(w):
        def run(batches):
            total = np.zeros(5)
            for b in batches:
                z, y, n = (b.column(k).to_numpy() for k in ("z", "y", "n"))
                p = 1 / (1 + np.exp(-np.clip(z * w[0] + w[1], -35, 35)))
                miss, curve = n * (p - y), n * p * (1 - p)
                total += [k.sum() for k in (miss * z, miss, curve * z * z, curve * z, curve)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

        # One plan for all steps: numbers in column expressions would be compiled anew in each.
        r = np.sum([k["total"] for k in map_arrow(held, run, "total array<double>").collect()], 0)
        return r[:2], np.array([[r[2], r[3]], [r[3], r[4]]])

    scale = newton(sums, 2, l2=1e-2)
    good = held.where("y = 1")
    high = at_rank(good, int(np.floor((1 - recall) * good.agg(F.sum("n")).first()[0])))
    below = held.where((F.col("y") == 0) & (F.col("z") < high)).agg(F.max("z")).first()[0]
    return calibrated(net, scale, high, below)


def train(docs: DataFrame, recall: float = RECALL, epochs: int = EPOCHS, seed: int = 3) -> Net:
    """Fit, calibrate and set the threshold on the findings of all documents (see ``findings`` and ``fit``)."""
    rows = cut(findings(docs), "findings")
    counts = {(r["check"], r["y"]): r["n"] for r in rows.groupBy("check", "y").agg(F.sum("n").alias("n")).collect()}
    state = begin(np.random.default_rng(seed))
    if len(counts) < 4:
        return network(parameters(state))
    size = counts[False, 0] + counts[False, 1]
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    dealt = cut(blocks(rows.where("NOT check"), ceil(size / BLOCK), tasks), "blocks").coalesce(tasks)
    for epoch in range(epochs):
        state = advance(dealt, state, balanced(counts[False, 1] / size), seed, epoch)
    net = network(parameters(state))
    return calibrate(net, cut(logits(rows.where("check"), net).coalesce(tasks), "held"), recall)


def scan_batch(texts: list[str], net: Net) -> list[list[tuple[int, int, int]]]:
    """All spans of each text as (start, kind, end), sorted."""
    spans = [rule_spans(t) for t in texts]
    open_ = []
    for i, t in enumerate(texts):
        for s, e in candidates(t) if net.threshold <= 1 else ():
            if not any(a <= s and e <= z for a, _, z in spans[i]):
                open_ += [(i, s, e, *view) for view in views(s, e)]
    hits = set()
    for k in range(0, len(open_), 512):
        part = open_[k : k + 512]
        x = np.stack([window(texts[i], a, z) for i, _, _, a, z in part])
        p = net.probability(x, np.array([shape(texts[i], a, z) for i, _, _, a, z in part]))
        hits |= {run[:3] for run, hit in zip(part, p >= net.threshold) if hit}
    for i, s, e in hits:
        spans[i].append((s, 3, e))
    return [sorted(s) for s in spans]


def scan(docs: DataFrame, net: Net, out: str = "spans") -> DataFrame:
    """Add ``out``, an array of (start, kind, end) in code points, to every row.

    A null text has no spans; a column named ``out`` is replaced.
    """
    kept = [k for k in docs.columns if k != out]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in row] for row in scan_batch(texts_of(b), net)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(found, kind)], [*kept, out])

    from pyspark.sql import types as T

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, T.ArrayType(span))])
    return map_arrow(docs.select(*kept), run, schema)


def redact(docs: DataFrame, net: Net, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` (overlaps joined) replaced by ``mask``; null stays null."""
    kept = docs.columns

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for t, spans in zip(texts, scan_batch([t or "" for t in texts], net)):
                done, parts = 0, []
                for s, _, e in spans:
                    if s >= done:
                        parts += [t[done:s], mask]
                    done = max(done, e)
                out.append("".join([*parts, t[done:]]) if spans else t)
            new = pa.array(out, b.column("text").type)
            yield pa.RecordBatch.from_arrays([new if k == "text" else b.column(k) for k in kept], kept)

    return map_arrow(docs, run, docs.schema)
