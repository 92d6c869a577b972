"""Vector codes and hard negatives against plain Python."""

import hashlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from touchstone.llm import hardneg, queries, vectorcodes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) rows and the digest, in Python integers."""
    rows = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    vectors = [[int(np.floor(4096 * float(x))) for x in r[1]] for r in rows]
    w = len(vectors[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in vectors]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    per_label = {}
    for r, e in zip(rows, errors):
        per_label[r[2]] = per_label.get(r[2], 0) + e
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, per_label[r[2]], digest) for r, f, e in zip(rows, found, errors)]


def table(spark, path=SF):
    return [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]


def key(r):
    return tuple((x is None, x or 0) for x in r[:1]) + tuple(r[1:])


def test_codes_equal_plain_python(spark):
    got = [tuple(r) for r in queries.QUERIES["op12_vector_codes"](spark, SF).collect()]
    assert sorted(got, key=key) == sorted(codes_by_hand(table(spark)), key=key)


def odd_vectors():
    rng = np.random.default_rng(1)
    grid = lambda: [float(x) for x in rng.integers(-2, 3, 16) / 4096]  # noqa: E731  many ties
    rows = [(i, grid(), i % 3 if i % 4 else None) for i in range(40)]
    rows += [(3, rows[3][1], 0), (3, rows[3][1], 0), (-7, grid(), 1), (None, grid(), 2), (None, grid(), None), (50, [-9.5] * 16, 1), (51, [1e30] * 16, 1)]
    bad = [(60, None, 1), (61, [None] + [0.0] * 15, 1), (62, [float("nan")] * 16, 1), (63, [float("inf")] + [0.0] * 15, 1), (64, [], 1), (65, [1.0] * 8, 1)]
    return rows, bad


def test_codes_of_odd_rows(spark):
    rows, bad = odd_vectors()
    wide = [(*r, "clash", 5) for r in rows + bad]
    df = spark.createDataFrame(wide, SCHEMA + ", code string, error int").repartition(3)
    coded, books = vectorcodes.compressed(df)
    got = [(r["vec_id"], r["code"].hex(), r["error"], r["label_error"], books.digest()) for r in vectorcodes.with_label_sums(coded).collect()]
    cut = [(i, [min(x, 32768.0) for x in v], y) for i, v, y in rows]
    assert sorted(got, key=key) == sorted(codes_by_hand(cut), key=key)
    assert vectorcodes.compressed(df.where("false"))[0].count() == 0
    few, books = vectorcodes.compressed(df.where("vec_id IN (1, 2, 61)"))
    assert books.entries.shape == (8, 2, 2) and {r["error"] for r in few.collect()} == {0}
    assert vectorcodes.compressed(df.where("vec_id IS NULL"))[0].count() == 2


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "FEW_LABELS", 1)
    rows, _ = odd_vectors()
    coded, _ = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA))
    found = vectorcodes.with_label_sums(coded)
    sums = {r["label"]: r["label_error"] for r in found.collect()}
    for label, total in sums.items():
        assert total == sum(r["error"] for r in coded.collect() if r["label"] == label)
    assert None in sums and found.count() == len(rows)


@pytest.mark.parametrize("entries,radius", [(16, 1), (70, 300), (200, 1e6)])
def test_slices_find_the_nearest_entry(entries, radius):
    rng = np.random.default_rng(entries)
    book, x = rng.integers(-50, 50, (entries, 3)), rng.integers(-80, 80, (500, 3))
    index, far = vectorcodes.Slices(book).nearest(x, radius)
    all_far = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (far == all_far.min(1)).all() and (index == all_far.argmin(1)).all()


def test_ties_across_boxes_go_to_the_lower_index():
    book = np.array([[9, 9], [50, 50], [50, -50], [0, 5], [40, 40], [3, 4]])
    index, far = vectorcodes.Slices(book).nearest(np.zeros((1, 2), int), 4)
    assert (index[0], far[0]) == (3, 25)


def test_candidates_are_the_entries_in_the_box():
    rng = np.random.default_rng(2)
    book, x = rng.integers(-9, 9, (130, 4)), rng.integers(-9, 9, (60, 4))
    radius = rng.integers(0, 9, 60)
    masks = vectorcodes.Slices(book).candidates(x, radius)
    inside = (np.abs(x[:, None] - book[None]) <= radius[:, None, None]).all(2)
    got = np.array([[(int(m[e // 64]) >> (e % 64)) & 1 for e in range(130)] for m in masks], bool)
    assert (got == inside).all()


def test_decoded_vectors_are_near(spark):
    rows = [r for r in table(spark) if r[1]]
    coded, books = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA))
    back = {r["vec_id"]: np.array(r["embedding"]) for r in vectorcodes.decode(coded, books).collect()}
    error = {r["vec_id"]: r["error"] for r in coded.collect()}
    for i, v, _ in rows:
        assert abs(((back[i] - np.array(v)) ** 2).sum() * 4096**2 - error[i]) < 0.05 * error[i] + 5000


def mined_by_hand(rows, scale=256, every=100, low=80):
    """Hard negatives in Python integers, from every score."""
    usable = [(i, [int(np.floor(scale * float(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    anchors = sorted({(i, tuple(v), y) for i, v, y in usable if i % every == 0})
    if anchors:
        usable, anchors = ([r for r in some if len(r[1]) == len(anchors[0][1])] for some in (usable, anchors))
    for i, v, y in anchors:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in usable if j != i)
        for p, j, _ in [r for r in scored if r[2] == y][:5]:
            fit = [(n, m) for n, m, z in scored if z != y and low * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, j, k + 1, m, -p, -n) for k, (n, m) in enumerate(fit)]
    return sorted(out)


def relabelled(rows):
    return [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]


@pytest.mark.parametrize("tree,panel,batch", [(1024, 8192, 2048), (3, 4, 50)])
def test_hard_negatives_equal_plain_python(spark, monkeypatch, tree, panel, batch):
    for name, value in (("TREE", tree), ("PANEL", panel), ("ROWS", batch)):
        monkeypatch.setattr(hardneg, name, value)
    rows = relabelled(table(spark))
    every = 100 if tree > 3 else 20
    got = hardneg.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, every=every)


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    grid = lambda: [float(x) / 256 for x in rng.integers(-1, 4, 4)]  # noqa: E731  many ties
    rows = [(100 * i if i < 6 else i, grid(), int(rng.integers(0, 3))) for i in range(60)]
    rows += [rows[20]] * 3 + [rows[2]] * 2 + [(100, grid(), 1), (200, [-x for x in rows[2][1]], 2), (-100, grid(), 0), (700, [0.0] * 4, 1)]
    bad = [(None, grid(), 1), (800, grid(), None), (900, None, 1), (901, [None] * 4, 1), (902, [float("nan")] * 4, 1), (1000, [float("inf")] * 4, 1), (903, [], 1), (1100, [0.5] * 3, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], SCHEMA + ", score int, anchor string").repartition(4)
    is_anchor = F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, hardneg.mine(df, is_anchor).collect())) == mined_by_hand(rows + bad)
    assert hardneg.mine(df.where("false"), is_anchor).count() == 0
    assert hardneg.mine(df.where("vec_id % 100 <> 0"), is_anchor).count() == 0
    assert hardneg.mine(df.where("vec_id = 100"), is_anchor).count() == 0


def test_spanning_trees_bound_scores_and_skip_candidates():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-5, 6, (40, 8)) + c for c in (100, -100)])
    order, parent, edge = hardneg.spanning_tree(v)
    assert sorted(order) == list(range(80)) and (parent[1:] < np.arange(1, 80)).all() and sorted(edge)[-1] > 400 > sorted(edge)[-2]
    tree = hardneg.Tree(1, 0, np.arange(80), v[order], parent, edge)
    x = rng.integers(-20, 21, (500, 8))
    norm = np.sqrt((x**2).sum(1))
    scored = 0
    for k, at, score in tree.walk(x, norm, lambda k: 4000, lambda k: 5000):
        full = x @ tree.v[k]
        assert (score == full[at]).all() and set(np.flatnonzero((full >= 4000) & (full <= 5000))) <= set(at)
        scored += len(at)
    assert scored < 0.6 * 80 * 500
