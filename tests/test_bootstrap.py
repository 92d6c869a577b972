"""The bootstrap on counts: draws, folds, and metrics of curves, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchstone.operators import bootstrap as B
from touchstone.operators import roc


@pytest.fixture(scope="module")
def preds(spark):
    """Two groups with many ties, one of which holds half of its rows."""
    rng = np.random.default_rng(8)
    rows = []
    for g in ("a", "b"):
        for i in range(600):
            y = int(rng.random() < 0.4)
            s = 0.5 if i % 2 else float(np.clip(round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1))
            rows.append((g, f"{g}{i}", y, s))
    return rows, spark.createDataFrame(rows, "g string, id string, label int, s double").repartition(5)


def cells(df):
    return B.cells_of(df, ["g"], "label", ["s"], "id").toPandas()


def weights(own, n_boot):
    return B.draws(own["hi"].to_numpy(), own["lo"].to_numpy(), own["n"].to_numpy(), np.arange(n_boot))


def plain_auc(s, y, w):
    p, n = w * (y == 1), w * (y == 0)
    above = (s[:, None] > s[None]) + 0.5 * (s[:, None] == s[None])
    return p @ above @ n / (p.sum() * n.sum())


def test_cells_count_every_row_once(preds):
    rows, df = preds
    own = cells(df)
    assert own["n"].sum() == len(rows) and len(own) < len(rows) / 3
    assert len(own) == len({(g, y, s) for g, _, y, s in rows})


def test_draws_are_poisson_and_repeatable():
    rng = np.random.default_rng(0)
    hi, lo = (rng.integers(0, 2**32, 300) for _ in range(2))
    for n in (1, 3, 50, 400, 401, 5000, 2_000_000):
        w = B.draws(hi, lo, np.full(300, n), np.arange(200))
        assert w.mean() == pytest.approx(n, abs=5 * np.sqrt(n / 60_000)) and w.var() == pytest.approx(n, rel=0.05)
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.25
        assert (w[:, 7] == B.draws(hi, lo, np.full(300, n), np.array([7]))[:, 0]).all()


def test_edges_agree_where_they_meet():
    for n in (B.PLAIN, B.PLAIN + 1):
        first, edges = B.poisson_edges(n)
        k = np.arange(first, first + len(edges))
        assert k[np.searchsorted(edges, 0.5)] == n
    _, edges = B.poisson_edges(1)
    assert edges[:3] == pytest.approx([np.exp(-1), 2 * np.exp(-1), 2.5 * np.exp(-1)])


@pytest.mark.parametrize("parts,fan,step", [(1, 128, 1024), (7, 2, 5)])
def test_fold_equals_all_pairs_in_every_replicate(spark, preds, monkeypatch, parts, fan, step):
    monkeypatch.setattr(B, "FAN", fan)
    monkeypatch.setattr(B, "STEP", step)
    _, df = preds
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = roc.bootstrap_values(df, ["auc"], "label", "s", "id", 12, by=["g"]).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    own = cells(df)
    for g, part in own.groupby("g"):
        w = weights(part, 12)
        want = [plain_auc(part["s"].to_numpy(), part["y"].to_numpy(), w[:, r]) for r in range(12)]
        assert got[got["g"] == g].sort_values("replicate")["auc"].to_list() == pytest.approx(want, abs=1e-12)


def test_tallies_merge_in_any_grouping():
    """Ties that run over two and three parts count half, however the parts are merged."""
    rng = np.random.default_rng(5)
    s = np.sort(rng.integers(0, 4, 40))[::-1].astype(float)
    y, w = rng.integers(0, 2, 40).astype(float), rng.integers(0, 4, (40, 6)).astype(float)
    want = B.tally(s, y, w)
    for _ in range(50):
        cuts = [0, *np.sort(rng.choice(np.arange(1, 40), 6, replace=False)), 40]
        parts = [B.tally(s[a:b], y[a:b], w[a:b]) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = rng.integers(0, len(parts) - 1)
            parts[i : i + 2] = [B.merge(parts[i], parts[i + 1])]
        for k in B.ARRAYS:
            assert (parts[0][k] == want[k]).all(), k


def test_curve_metrics_equal_the_score_table(spark, preds):
    _, df = preds
    names = [m for m in B.CELL_METRICS]
    table = roc.score_table(df, "label", "s", ["g"])
    want = {r["g"]: r for r in roc.summarize(table, ["g"], **{m: roc.METRICS[m]() for m in names}).collect()}
    own = B.cells_of(df, ["g"], "label", ["s"], "id")
    got = B.cell_replicates(own, ["g"], "s", B.CELL_METRICS, 3).where("replicate = -1").collect()
    assert len(got) == 2
    for r in got:
        for m in names:
            assert r[m] == pytest.approx(want[r["g"]][m], abs=1e-12), m


def test_large_groups_take_the_score_table_with_the_same_draws(preds, monkeypatch):
    _, df = preds
    ask = lambda: {(r["g"], r["replicate"]): (r["eer"], r["ap"]) for r in roc.bootstrap_values(df, ["eer", "ap"], "label", "s", "id", 9, by=["g"]).collect()}
    held = ask()
    monkeypatch.setattr(B, "CELLS", 1)
    summed = ask()
    assert held.keys() == summed.keys() and len(held) == 18
    for k, v in held.items():
        assert summed[k] == pytest.approx(v, abs=1e-12)


def test_any_function_of_labels_and_scores(preds):
    rows, df = preds

    def spread(y, s):
        assert len(y) == len(s) and set(y) == {0, 1}
        return s[y == 1].mean() - s[y == 0].mean()

    got = {r["g"]: r for r in roc.bootstrap_ci(df, spread, "label", "s", "id", 80, by=["g"]).collect()}
    for g in "ab":
        y, s = (np.array(c) for c in zip(*[(y, s) for h, _, y, s in rows if h == g]))
        assert got[g]["point"] == pytest.approx(spread(y, s)) and got[g]["n_valid"] == 80
        assert got[g]["lo"] < got[g]["point"] < got[g]["hi"]
    nothing = roc.bootstrap_ci(df, lambda y, s: float("nan"), "label", "s", "id", 60, by=["g"]).collect()
    assert {(r["point"], r["n_valid"], r["lo"]) for r in nothing} == {(None, 0, None)}


def test_one_draw_serves_both_scorings(spark, preds):
    _, df = preds
    pair = df.withColumn("t", 1 - F.col("s"))
    own = B.cells_of(pair, ["g"], "label", ["s", "t"], "id")
    one = {(r["g"], r["replicate"]): r["auc"] for r in B.auc_replicates(own, ["g"], "s", 20).collect()}
    two = {(r["g"], r["replicate"]): r["auc"] for r in B.auc_replicates(own, ["g"], "t", 20).collect()}
    assert one.keys() == two.keys() and all(one[k] + two[k] == pytest.approx(1) for k in one)


def test_one_class_empty_tables_and_odd_rows(spark):
    rows = [("x", "1", 1, 0.5), ("x", "2", 1, 0.6), (None, "3", 1, 0.1), ("y", "4", None, 0.2), ("y", "5", 1, None), ("y", "6", 0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, id string, label int, s double")
    got = roc.bootstrap_ci(df, "auc", "label", "s", "id", 60, by=["g"]).where("g = 'x'").first()
    assert got["n_valid"] == 0 and got["lo"] is None and got["point"] is None
    assert roc.bootstrap_values(df.where("false"), ["auc"], "label", "s", "id", 5).count() == 0
    assert roc.bootstrap_values(df.where("false"), ["eer"], "label", "s", "id", 5, by=["g"]).count() == 0


def test_shuffled_rows_do_not_grow_with_replicates(spark, preds):
    """Few and many replicates deal out the same cells; only their arrays get longer."""
    _, df = preds
    own = B.cells_of(df, ["g"], "label", ["s"], "id")
    dealt = lambda n: own.withColumn("_block", F.explode(F.sequence(F.lit(-1), F.lit((n - 1) // max(1, -(-n // B.BLOCKS)))))).count()
    assert dealt(2000) == dealt(200) == (B.BLOCKS + 1) * own.count()
