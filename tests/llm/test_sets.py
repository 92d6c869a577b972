"""Near duplicates, repeated strings, neighbours and fingerprints against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from touchstone.llm import neardup, neighbours, queries, substrings, syncmers

SF = "/root/testdata/sf0.001"


def shingle_sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def components_by_hand(rows, k, num, den):
    sets, up = shingle_sets(rows, k), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)}


def check_groups(spark, rows, k, num, den):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k, num, den).collect()}
    assert got == components_by_hand(rows, k, num, den)


def edited_copies(seed, n, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            copy[rng.randrange(words)] = f"w{rng.randrange(6)}"
        if rng.random() < 0.2:
            copy = copy[: rng.randrange(words // 2, words)]
        rows.append((i, " ".join(copy)))
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_groups(spark, rows, 3, 85, 100)


@pytest.mark.parametrize("hot,rare", [(64, 16), (4, 2)])
def test_groups_of_near_copies(spark, monkeypatch, hot, rare):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "RARE", rare)
    check_groups(spark, edited_copies(1, 150) + [(1000 + i, t) for i, t in edited_copies(2, 30)], 3, 85, 100)
    check_groups(spark, edited_copies(3, 90), 5, 80, 100)


def test_near_duplicates_are_found_by_small_queries(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "RARE", 2)
    docs = spark.createDataFrame(edited_copies(1, 150) + [(1000 + i, t) for i, t in edited_copies(2, 30)], "doc_id long, text string")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def jobs():
        bus.waitUntilEmpty(60_000)
        found = store.executionsList(max(0, store.executionsCount() - 100), 100)
        return {found.apply(i).executionId(): found.apply(i).jobs().size() for i in range(found.size())}

    last = max(jobs(), default=-1)
    corpus_pipeline.deduplicate(spark, docs, "").collect()
    ran = [n for i, n in jobs().items() if i > last]
    assert len(ran) > 10 and max(ran) <= 12  # the driver keeps and plans a query anew with each job; one took 39


def test_near_duplicates_shuffle_no_texts(spark):
    rng = random.Random(4)
    rows = edited_copies(1, 60) + [(1000 + i, " ".join(str(rng.random()) for _ in range(50))) for i in range(200)]
    docs = spark.createDataFrame(rows + [(None, "no id")], "doc_id long, text string")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty(60_000)
        found = store.executionsList(max(0, store.executionsCount() - 100), 100)
        return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}

    last, before = max(plans(), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than a broadcast takes
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ran = [p for i, p in plans().items() if i > last]
    exchanged = [x for p in ran for x in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", p)]
    assert len(exchanged) > 20 and not [x for x in exchanged if "text#" in x]
    assert got == components_by_hand(rows, 3, 85, 100) | {None: (1, None)}


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_the_filter_of_ids_misses_none(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    docs = spark.range(-20_000, 20_000).selectExpr("id * 7919 AS doc_id", "'x' AS text")
    ids = docs.where("pmod(doc_id, 40) = 0").select("doc_id")
    got = neardup.likely(docs.union(docs.selectExpr("NULL", "text").limit(5)), ids)
    assert got.join(ids, "doc_id", "left_semi").count() == ids.count() == 1000
    assert got.where("doc_id IS NULL").count() == 0 and (most == 64 or got.count() < 1400)
    assert neardup.likely(docs, ids.where("false")).count() == 0
    rows = edited_copies(1, 60) + [(1000 + i, t) for i, t in edited_copies(2, 30)]
    check_groups(spark, rows, 3, 85, 100)


def test_near_duplicates_of_odd_rows(docs, empty):
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got[100, 11]["component_id"] == 0 and not got[100, 11]["kept"]
    assert got[2, 0]["kept"] and got[3, 0]["kept"] and got[4, 1]["kept"] and got[5, 1]["component_id"] == 5
    assert neardup.near_duplicates(docs).count() == docs.count()
    assert neardup.near_duplicates(empty).count() == 0


def test_ids_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    near = b.replace("b39", "other")
    rows = [(1, a), (1, b), (9, b), (11, near), (20, a), (21, a), (0, near)]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).select("doc_id", "component_id", "kept").collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (9, 0, False), (11, 0, False), (20, 1, False), (21, 1, False)]
    rows = rows[:-1]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert all(r["component_id"] == 1 and r["kept"] == (r["doc_id"] == 1) for r in got) and len(got) == 6


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    for share in (1.0, 0.95, 0.9):
        b = np.r_[a[: int(share * len(a))], rng.integers(0, 2**63, len(a) - int(share * len(a))).astype(np.uint64)]
        x = np.bitwise_count(neardup.odd_sketch(neardup.minhashes(a)) ^ neardup.odd_sketch(neardup.minhashes(np.unique(b)))).sum()
        m, k = 64 * neardup.SKETCH_WORDS, neardup.BANDS * neardup.ROWS
        assert abs(1 + m / (4 * k) * np.log(1 - 2 * x / m) - share / (2 - share)) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 300), (200, 300)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100


def repeats_by_hand(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = [x for x in bytes(gone).split(b"\0") if x]
        out.append((len(b), sum(gone), len(runs), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check_repeats(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.without_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_by_hand(texts, substrings.LENGTH)


def test_repeats_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_repeats(spark, texts)


def test_repeats_in_made_up_texts(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 260, 700)]
    texts = [None, "", noise(199), "a" * 1000, "ab" * 300, noise(500)] + [noise(rng.randrange(300)) + rng.choice(shared) + noise(rng.randrange(300)) for _ in range(40)]
    texts += [shared[4][100:500] + shared[3], texts[-1], texts[-1], shared[1], shared[1]]
    check_repeats(spark, texts)


def test_repeats_of_odd_rows(docs, empty):
    assert substrings.without_repeats(docs).count() == docs.count()
    assert substrings.without_repeats(empty).count() == 0


def neighbours_by_hand(ids, x, q, k):
    s = x @ x[q]
    order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    got = queries.QUERIES["op7_neighbours"](spark, "/root/testdata/sf0.1").toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        want = neighbours_by_hand(ids, x, q, 20)
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        hits += len(set(mine["vec_id"]) & {i for i, _ in want})
        total += len(want)
        score = {i: s for i, s in zip(ids, x @ x[q])}
        assert np.allclose(mine["score"], [score[i] for i in mine["vec_id"]], atol=1e-12)
    assert hits / total >= 0.9


@pytest.mark.parametrize("spread", ["0.5", "uniform"])
def test_neighbours_of_unequal_lengths(spark, spread):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 32))[rng.integers(60, size=4000)] + 0.7 * rng.normal(size=(4000, 32))
    size = rng.uniform(0.5, 2, 4000) if spread == "uniform" else rng.lognormal(0, float(spread), 4000)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * size[:, None]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame).groupBy("query_id").agg({"vec_id": "collect_set"}).collect()
    assert len(got) == 200
    found = [len(set(ids) & {i for i, _ in neighbours_by_hand(np.arange(4000), x.astype(float), q, 20)}) for q, ids in got]
    assert sum(found) / 20 / len(found) >= 0.95


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4) * (1 + i % 5)]) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 4), (100, [float("nan"), 1.0, 1.0, 1.0]), (120, [None, 1.0, 1.0, 1.0]), (140, [float("inf")] * 4), (None, [1.0] * 4)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame).toPandas()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids, x = np.array(list(good)), np.stack(list(good.values()))
    assert set(got["query_id"]) == {i for i in good if i % 20 == 0}
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got["query_id"] == ids[q]].sort_values("rank")["vec_id"].tolist()
        assert mine == [i for i, _ in neighbours_by_hand(ids, x, q, 20)]
    assert neighbours.nearest(frame.where("false")).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 20")).count() == 0


def test_syncmers_are_context_free():
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = noise(400)
    at1, h1 = syncmers.choose(noise(100) + shared + noise(50))
    at2, h2 = syncmers.choose(shared)
    inside = {(a - 100, h) for a, h in zip(at1.tolist(), h1.tolist()) if 100 <= a <= 500 - syncmers.K}
    assert inside == set(zip(at2.tolist(), h2.tolist())) and len(inside) > 20
    raw = shared.encode()
    for a in range(len(raw) - syncmers.K + 1):  # equal k-mers are chosen alike
        alone = len(syncmers.choose(raw[a : a + syncmers.K].decode())[0])
        assert bool(alone) == (a in at2)


def test_fingerprints_of_next_and_edited(spark, docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows.sort()
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_fingerprints"](spark, SF).collect()}
    for k, (i, t) in enumerate(rows):
        new = syncmers.edited(t, rows[(k + 1) % len(rows)][1])
        assert len(new) <= len(t) and got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert got[i]["fingerprint"] == syncmers.written(syncmers.sketch(t))
        assert got[i]["near_next"] == syncmers.likeness(syncmers.sketch(t), syncmers.sketch(rows[(k + 1) % len(rows)][1]))
    assert syncmers.compare_with_next(docs).count() == docs.count()
    assert syncmers.compare_with_next(empty).count() == 0
    alone = syncmers.compare_with_next(docs.where("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert syncmers.fingerprints(docs).count() == docs.count()
    assert syncmers.anchors(docs.where("doc_id = 4")).count() == 1
