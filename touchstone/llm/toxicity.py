"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, undoes digit
substitutions and turns all else into single spaces, so that entries are anchored at word
starts (``" stem"``) or hold whole words (``" word "``). Entries and exception phrases can
be given or learned from labelled rows; their weights are log odds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, logistic, map_arrow, texts_of

#: Labelled documents of each class that are read at most, and entries of a lexicon at most.
TRAIN_PER_CLASS = 8000
ENTRIES = 6000
#: An entry needs so many toxic documents and this log odds.
LEAST_TOXIC, LEAST_ODDS = 3, 1.2
STEM = (4, 10)
CUT = 0.5

# Look-alike letters of other scripts, and digits or signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_UNDO = str.maketrans(DIGITS)
_MIXED = re.compile(r"[^\W\d_]*[0-9@$](?:[^\W_]|[@$])*")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


class _Letters(dict):
    """Code point to itself, its look-alike, or a space; filled as characters turn up."""

    def __missing__(self, point: int) -> str:
        ch = chr(point)
        if 0xFF01 <= point <= 0xFF5E:
            ch = chr(point - 0xFEE0).lower()
        ch = LOOKALIKES.get(ch, ch)
        self[point] = out = ch if ch.isalpha() else " "
        return out


_LETTERS = _Letters()
_FULLWIDTH = {p: chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F)}


def fold_text(text: str) -> str:
    """``" word word "``: folded words; words with digits come again at the end, undone."""
    low = text.lower()
    if not low.isascii():
        low = _HIDDEN.sub("", low)
        if any(c in low for c in "０１３４５７８＠＄"):
            low = low.translate(_FULLWIDTH)
    mixed = [w for w in _MIXED.findall(low) if w.strip("0123456789@$")]
    tail = [w.rstrip("@$").translate(_UNDO) for w in mixed]
    whole = f"{low} {' '.join(tail)}" if tail else low
    return " " + " ".join(whole.translate(_LETTERS).split()) + " "


@dataclass
class Lexicon:
    """``weights``: entry to log odds; ``exceptions``: phrases inside which nothing counts."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    coef: list[float] = field(default_factory=lambda: [-4.0, 0.5, 0.5, 0.0, 1.0, 1.0])

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (len(entry), w))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def measure(self, automaton, text: str) -> tuple[list[float], list[tuple[int, int, float]]]:
        """(features, hits): one hit per word, by its longest entry, none inside an exception."""
        folded = fold_text(text)
        n = max(1, folded.count(" ") - 1)
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in automaton.iter(folded) if len(automaton) else ():
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif best.get(start, (0, 0))[0] < size:
                best[start] = (size, w)
        spared.sort()
        hits, at, far = [], 0, -1
        for s, (size, w) in sorted(best.items()):
            while at < len(spared) and spared[at][0] <= s:
                far = max(far, spared[at][1])
                at += 1
            if s + size - 1 > far:
                hits.append((s, size, w))
        total = sum(w for _, _, w in hits)
        top = max((w for _, _, w in hits), default=0.0)
        strong = sum(w >= 2.5 for _, _, w in hits)
        return [1.0, np.log1p(total), total / np.sqrt(n), min(1.0, 10 * len(hits) / n), top, np.log1p(strong)], hits

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.coef), -35, 35)))


def entries_of(folded: str) -> set[str]:
    """Whole words and their stems, as entries."""
    out = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 24:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return out


def learn(sample: DataFrame, entries: int = ENTRIES) -> Lexicon:
    """Lexicon, exceptions and weights of the final score from (doc_id, text, y) rows.

    Document counts are summed by Spark; only entries that are clearly more frequent in
    toxic documents come to the driver, ``entries`` of them at most.
    """

    def count(batches):
        for b in batches:
            seen: dict[tuple[str, int], int] = {}
            for t, y in zip(texts_of(b), b.column("y").to_pylist()):
                for e in entries_of(fold_text(t)):
                    seen[e, y] = seen.get((e, y), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([e for e, _ in seen], pa.string()), pa.array([n if y else 0 for (_, y), n in seen.items()], pa.int64()),
                 pa.array([0 if y else n for (_, y), n in seen.items()], pa.int64())], ["entry", "bad", "good"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return Lexicon({})
    odds = F.log((F.col("bad") + 0.3) / (n_bad + 0.6)) - F.log((F.col("good") + 0.3) / (n_good + 0.6))
    rows = (
        map_arrow(sample, count, "entry string, bad long, good long")
        .groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("odds", odds)
        .where((F.col("bad") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc(F.col("bad") * F.col("odds")), "entry").limit(entries).collect()
    )
    lexicon = Lexicon({r["entry"]: float(r["odds"]) for r in rows})
    lexicon.exceptions = _exceptions(sample, lexicon)
    x, y = _measured(sample, lexicon)
    balance = np.where(y == 1, 0.5 * len(y) / max(1, (y == 1).sum()), 0.5 * len(y) / max(1, (y == 0).sum()))
    lexicon.coef = list(logistic(x, y, l2=1.0, weight=np.sqrt(balance)))
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 3, most: int = 500) -> set[str]:
    """Two-word phrases with a hit that occur in good documents only, ``least`` times."""

    def phrases(batches):
        machine = lexicon.automaton()
        for b in batches:
            out = []
            for t, y in zip(texts_of(b), b.column("y").to_pylist()):
                folded = fold_text(t)
                for s, size, w in lexicon.measure(machine, t)[1]:
                    end = folded.index(" ", s + 1)
                    after = folded.find(" ", end + 1)
                    before = folded.rfind(" ", 0, s)
                    out += [(folded[s : after + 1], y)] if after > 0 else []
                    out += [(folded[before : end + 1], y)] if before >= 0 else []
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["phrase", "y"])

    rows = (
        map_arrow(sample, phrases, "phrase string, y int").groupBy("phrase")
        .agg(F.sum(F.lit(1) - F.col("y")).alias("good"), F.sum("y").alias("bad"))
        .where((F.col("bad") == 0) & (F.col("good") >= least)).orderBy(F.desc("good"), "phrase").limit(most).collect()
    )
    return {r["phrase"] for r in rows}


def _measured(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        machine = lexicon.automaton()
        for b in batches:
            x = [lexicon.measure(machine, t)[0] for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = map_arrow(sample, run, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return np.array(rows["x"].tolist(), float), rows["y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Lexicon:
    """Learn from a bounded sample of labelled rows outside the held-out fold."""
    from ..session import cut

    return learn(cut(labelled_sample(docs, labels, "toxic", fold(5) == 0, per_class), "toxic-sample"))


def score(docs: DataFrame, lexicon: Lexicon, out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1) and ``n_hits``; null texts count as empty, rows are kept as they are."""
    extra = [out, "n_hits"]
    kept = [k for k in docs.columns if k not in extra]

    def run(batches):
        machine = lexicon.automaton()
        for b in batches:
            got = [lexicon.measure(machine, t) for t in texts_of(b)]
            s = lexicon.score(np.array([x for x, _ in got], float).reshape(len(got), -1)) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in kept], pa.array(s, pa.float64()), pa.array([len(h) for _, h in got], pa.int64())], [*kept, *extra])

    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).withColumn("n_hits", F.lit(0).cast("long")).schema
    return map_arrow(docs.select(*kept), run, schema)
