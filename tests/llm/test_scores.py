"""Quality, toxicity and secrets: held-out accuracy, brute force, odd rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchstone.llm import queries, quality, secrets, toxicity
from touchstone.llm.common import logistic

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label, sf="/root/testdata/sf0.1"):
    got = queries.QUERIES[query](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got["score"].between(0, 1).all()
    both = got.merge(labels[labels[label].notna()], on="doc_id")
    return both[both["held_out"]]


def test_quality_on_the_held_out_fold(spark):
    rows = held_out(spark, "op1_quality", "quality")
    assert ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.97


def test_toxicity_on_the_held_out_fold(spark):
    rows = held_out(spark, "op2_toxicity", "toxic")
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.95


def test_ranking_orders_pairs_and_survives_one_class():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 21)), rng.integers(0, 2, 400)
    x[:, 3] += 3 * y
    s = quality.fit(x, y).score(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.3
    assert (quality.fit(x, np.ones(400)).score(x) >= quality.CUT - 1e-12).all()
    assert len(quality.fit(x[:0], y[:0]).score(x)) == 400


def test_folding():
    assert toxicity.fold_text("") == "  "
    assert " idiot " in toxicity.fold_text("1d10t!")
    assert " idiot " in toxicity.fold_text("ІDІОТ")  # Cyrillic letters
    assert " idiot " in toxicity.fold_text("ｉｄｉｏｔ")
    assert " a b " in toxicity.fold_text("a, 12 b")


def test_lexicon_takes_the_longest_entry_and_skips_exceptions():
    lexicon = toxicity.Lexicon({" bad": 1.0, " badly ": 3.0}, {" bad luck "})
    machine = lexicon.automaton()
    assert [w for _, _, w in lexicon.measure(machine, "badly bad baddest")[1]] == [3.0, 1.0, 1.0]
    assert lexicon.measure(machine, "bad luck")[1] == []
    assert toxicity.Lexicon({}).measure(toxicity.Lexicon({}).automaton(), "x")[1] == []


def rules_by_hand(text):
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [("assign", rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    out = []
    for k, (name, rule) in enumerate(kinds):
        for m in re.finditer(rule, text or ""):
            if len(m[2] if name == "assign" else m[0]) >= (12, 18, 16)[k]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_secret_rules_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_secrets"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = hashlib.sha256(rules_by_hand(r["text"]).encode()).hexdigest()
        assert got[r["doc_id"]]["base_sha256"] == want


@pytest.mark.parametrize("seed", range(3))
def test_secret_rules_on_made_up_texts(seed):
    rng = random.Random(seed)
    parts = ["token", "TOKEN", "secret", " = ", ":", '"', "AKIA", "A1B2C3D4", "0123456789abcdef", "api_key", "ſ", "K", "é", " ", "=", "."]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.rule_spans(t))
        assert got == rules_by_hand(t)


def test_network_separates_keys_from_words(spark):
    rng = np.random.default_rng(1)
    key = lambda: "".join(rng.choice(list("abcdef0123456789"), 32))
    word = lambda: "".join(rng.choice(["chapter", "page", "of", "book", "2020"], 6))
    texts = [f"my thing {key() if i % 2 else word()} and so on" for i in range(600)]
    spans = [(9, 9 + len(t.split(" ")[2])) for t in texts]
    x = np.stack([secrets.window(t, *s) for t, s in zip(texts, spans)])
    extra = np.array([secrets.shape(t, *s) for t, s in zip(texts, spans)])
    y = np.arange(600) % 2
    net = secrets.fit(x, extra, y, np.arange(600) % 4 < 2)
    assert ((net.probability(x, extra) >= net.threshold) == y).mean() > 0.97
    assert secrets.fit(x, extra, np.zeros(600, int), y == 1).threshold > 1


class Finds:
    """A network that finds what holds a q."""

    threshold = 0.5

    def probability(self, x, extra):
        return (x == secrets._CLASS[ord("q")]).any(1).astype(float)


def test_network_is_asked_about_every_run_that_no_rule_covers_whole():
    keys = ["qABCDEF0123456789abcdef0123XYZ", "qwertzuiopasdfghjkl", "a1" * 60 + "q" + "b2" * 60]
    for key in keys:
        assert (4, 3, 4 + len(key)) in secrets.scan_batch([f"see {key} here"], Finds())[0]
    assert [k for _, k, _ in secrets.scan_batch(["token=qwertzuiopasdfghjkl"], Finds())[0]] == [0]
    assert secrets.scan_batch(["=" * 40], Finds()) == [[]]


def test_threshold_keeps_the_wanted_recall():
    rng = np.random.default_rng(6)
    y = (rng.random(4000) < 0.1).astype(int)
    x = rng.integers(0, secrets.CLASSES, (4000, 80)).astype(np.int16)
    extra = rng.normal(size=(4000, 4)) + 0.5 * y[:, None]
    check = np.arange(4000) % 2 == 0
    net = secrets.fit(x, extra, y, check, epochs=2)
    good = net.probability(x[check], extra[check])[y[check] == 1]
    assert (good >= net.threshold).mean() >= secrets.RECALL


def test_network_learns_from_all_documents(spark):
    """Secrets only in the last 2,000 of 22,000 documents in order of a hash."""
    rng = random.Random(4)
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    ids = spark.range(22000).orderBy(F.xxhash64("id"), "id").collect()
    texts = [f"see {key(18, '0123456789')} there" for _ in range(2000)] + ["see there"] * 18000
    texts += [f"secret={key(24, 'abcdefghijklmnopqrstuvwxyz0123456789')} there" for _ in range(2000)]
    docs = spark.createDataFrame([(r[0], t) for r, t in zip(ids, texts)], "doc_id long, text string")
    rows = secrets.findings(docs).groupBy("y").agg(F.sum("n")).collect()
    assert sorted(map(tuple, rows)) == [(0, 2000), (1, 6000)]
    net = secrets.train(docs, epochs=4)
    assert net.threshold <= 1
    fresh = [key(24, "abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(50)]
    assert sum(bool(s) for s in secrets.scan_batch([f"see {k} there" for k in fresh], net)) >= 45
    assert not any(secrets.scan_batch(["see a-chapter-of-a-book there"], secrets.train(docs.limit(0))))


def test_copies_and_rows_without_id_are_trained_on(spark):
    rows = [(None, "secret=abcdefgh12345678xyz")] * 3 + [(7, "0123456789 0123456789012345")] * 2 + [(None, None), (1, "")]
    got = secrets.findings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["y"], r["n"]) for r in got) == [(0, 2), (1, 3), (1, 6)]
    packed = secrets.blocks(secrets.findings(spark.createDataFrame(rows, "doc_id long, text string")), 3, 2).collect()
    assert sum(len(r["y"]) for r in packed) == 11 and sum(sum(r["y"]) for r in packed) == 9
    assert all(len(r["x"]) == 80 * len(r["y"]) and len(r["extra"]) == 32 * len(r["y"]) for r in packed)


def test_a_round_is_the_mean_of_the_blocks_in_any_layout(spark):
    rng = np.random.default_rng(8)
    x, extra, y = rng.integers(0, secrets.CLASSES, (5, 300, 80)).astype(np.uint8), rng.normal(size=(5, 300, 4)), rng.integers(0, 2, (5, 300)).astype(np.uint8)
    table = spark.createDataFrame([(i, bytearray(x[i].tobytes()), bytearray(extra[i].tobytes()), bytearray(y[i].tobytes())) for i in range(5)], "block long, x binary, extra binary, y binary")
    state, weights = secrets.begin(rng), (0.6, 2.0)
    got = [secrets.advance(table.repartition(k), state, weights, 3, 1) for k in (1, 3)]
    assert (got[0] == got[1]).all()
    each = [secrets.descend(state, x[i], extra[i], y[i], weights, np.random.default_rng([3, 1, i]).permutation(300)) for i in range(5)]
    assert np.allclose(got[0], np.mean(each, 0), atol=1e-9)


def test_gradient_equals_differences():
    """A first step of Adam goes against the sign of the gradient."""
    rng = np.random.default_rng(2)
    x, extra, y = rng.integers(0, secrets.CLASSES, (40, 80)), rng.normal(size=(40, 4)), rng.integers(0, 2, 40)
    state = secrets.begin(rng)

    def loss(flat):
        z = secrets.network(flat).logits(x, extra)
        return (np.where(y == 1, 2.0, 0.6) * (np.logaddexp(0, z) - y * z)).mean() + 0.5e-4 * (flat[-2 * secrets.FILTERS - 5 :] ** 2).sum()

    flat = secrets.parameters(state)
    grad = np.split(secrets.descend(state, x, extra, y, (0.6, 2.0), np.arange(40))[:-1], 3)[1] * 10
    for i in [*rng.integers(0, len(flat), 40), *range(len(flat) - 60, len(flat))]:
        move = np.zeros(len(flat))
        move[i] = 1e-6
        assert abs((loss(flat + move) - loss(flat - move)) / 2e-6 - grad[i]) < 1e-6


@pytest.mark.parametrize("apart", [0.0, 3.0, 50.0])
def test_calibration_over_a_table_equals_one_in_memory(spark, apart):
    rng = np.random.default_rng(9)
    y, n = (rng.random(3000) < 0.2).astype(int), rng.integers(1, 4, 3000)
    z = np.round(rng.normal(size=3000), 2) + apart * y
    net = secrets.calibrate(secrets.network(secrets.parameters(secrets.begin(rng))), spark.createDataFrame(list(zip(z.tolist(), y.tolist(), n.tolist())), "z double, y int, n long"))
    z, y = np.repeat(z, n), np.repeat(y, n)
    scale = logistic(np.stack([z, np.ones_like(z)], 1), y.astype(float), l2=1e-2)
    assert np.allclose(net.scale, (max(scale[0], 1e-3), scale[1]))
    good = np.sort(z[y == 1])
    high = good[int(np.floor((1 - secrets.RECALL) * len(good)))]
    middle = (high + z[(y == 0) & (z < high)].max()) / 2
    assert np.isclose(net.threshold, 1 / (1 + np.exp(-np.clip(net.scale[0] * middle + net.scale[1], -35, 35))))


def test_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    ranking, lexicon, net = quality.train(docs, labels), toxicity.train(docs, labels), secrets.train(docs)
    for frame in (docs, empty):
        a = quality.score(frame, ranking)
        b = toxicity.score(frame, lexicon)
        c = secrets.scan(frame, net)
        d = secrets.redact(frame, net)
        assert a.count() == b.count() == c.count() == d.count() == frame.count()
        assert set(a.columns) == set(docs.columns) and d.schema == frame.schema
    assert quality.train(empty, labels.where("false")).score(quality.features(["", "x"])).shape == (2,)
    assert not toxicity.train(empty, labels).weights
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, net).collect()}
    assert [s["kind"] for s in spans[6]] == ["assign", "hex", "access"] and spans[3] == [] == spans[2]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, net).collect()}
    assert clean[6] == "x [SECRET]\" y [SECRET] z" and clean[3] is None and clean[4] == "one"


def test_hits_inside_exceptions_equal_a_naive_search():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" bad ": 2.0, " awful": 1.5, " ugly ": 3.0}, {" not bad ", " bad luck ", " awful nice "})
    machine = lexicon.automaton()
    for _ in range(300):
        folded = toxicity.fold_text(" ".join(rng.choice(["bad", "awful", "awfully", "ugly", "not", "luck", "nice"]) for _ in range(rng.randrange(30))))
        spans = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
        found = [(i, len(e), w) for e, w in lexicon.weights.items() for i in range(len(folded)) if folded.startswith(e, i)]
        want = sorted(h for h in found if not any(a <= h[0] and h[0] + h[1] <= b for a, b in spans))
        assert lexicon.measure(machine, folded)[1] == want
    started = time.process_time()
    assert lexicon.measure(machine, "not bad " * 200_000)[1] == []
    assert time.process_time() - started < 20
