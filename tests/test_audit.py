"""Planted defects: every kind of leak is found, and clean tables pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchstone.operators import duplicates as D
from touchstone.operators import manifest as MF
from touchstone.operators import sampling
from touchstone.schemas import MANIFEST, SchemaError
from touchstone.session import new_path
from touchstone.sources import manifests as S


def manifest(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        label = r.get("label", 0)
        row = {
            "video_id": f"v{i}", "path": f"/d/v{i}.mp4", "label": label, "dataset": "ffpp",
            "forgery_method": "real" if label == 0 else "Deepfakes", "split": "train", "has_audio": True,
            "source_identity": f"p{i}", "compression": "c23", "fps": 25.0, "n_frames": 100, "duration_s": 4.0,
            "sha256": "a" * 64,
        }
        row.update(r)
        out.append(tuple(row[k] for k in MANIFEST.names))
    return spark.createDataFrame(out, MANIFEST)


def test_clean_manifest_passes(spark):
    m = manifest(spark, {}, {"split": "val"}, {"split": "test", "label": 1})
    assert MF.assert_clean(m).first()["ok"]


def test_identity_overlap_blocks_and_crosses_datasets_freely(spark):
    m = manifest(spark, {"source_identity": "x"}, {"source_identity": "x", "split": "test"}, {"source_identity": "x", "split": "val", "dataset": "dfdc"})
    got = [tuple(r) for r in MF.identity_overlap(m).collect()]
    assert got == [("ffpp", "test|train", "x")]
    with pytest.raises(MF.ManifestError):
        MF.assert_clean(m)


def test_three_splits_give_three_pairs(spark):
    m = manifest(spark, *[{"source_identity": "x", "split": s} for s in ("train", "val", "test")])
    assert sorted(r["pair"] for r in MF.identity_overlap(m).collect()) == ["test|train", "test|val", "train|val"]


def test_row_rules_collect_every_error(spark):
    m = manifest(spark, {"fps": 0.0, "n_frames": 0, "label": 1, "forgery_method": "real"}, {"forgery_method": " real "})
    good, bad = MF.validate(m)
    assert good.first()["forgery_method"] == "real"
    assert bad.first()["errors"] == ["fps: not positive", "n_frames: not positive", "label 1 needs a named method"]


def test_bad_and_duplicate_rows_are_refused(spark):
    with pytest.raises(MF.ManifestError, match="1 invalid rows"):
        S.write_manifest(manifest(spark, {"fps": -1.0}), new_path(spark, "m"))
    with pytest.raises(MF.ManifestError, match="duplicate"):
        MF.concat_manifests(manifest(spark, {}), manifest(spark, {}))


def test_round_trip_filters_and_version(spark):
    path = new_path(spark, "m")
    S.write_manifest(manifest(spark, {}, {"split": "val", "has_audio": False}), path)
    assert S.read_manifest(spark, path, split="val", has_audio=False).count() == 1
    bare = new_path(spark, "m")
    manifest(spark, {}).write.parquet(bare)
    with pytest.raises(SchemaError, match="version 0"):
        S.read_manifest(spark, bare)
    with pytest.raises(SchemaError, match=r"\['fps'\]"):
        short = new_path(spark, "m")
        manifest(spark, {}).drop("fps").write.parquet(short)
        S.read_manifest(spark, short)


# ---- near duplicates ----------------------------------------------------------------
def brute(hashes, threshold=6, min_frames=3):
    out = set()
    items = sorted(hashes.items())
    for i, (a, ha) in enumerate(items):
        for b, hb in items[i + 1 :]:
            if not ha or not hb:
                continue
            ds = [d for d in (bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(ha, hb)) if d <= threshold]
            if len(ds) >= min_frames:
                out.add((a, b, sum(ds) // len(ds)))
    return out


def expand(spark, df, hot_key):
    links = [tuple(r) for r in D.near_duplicates(df, hot_key=hot_key).collect()]
    groups = {}
    for r in D.members(df).collect():
        groups.setdefault(r["rep"], []).append(r["video_id"])
    out = []
    for a, b, n_a, n_b, _, dist in links:
        assert (len(groups[a]), len(groups[b])) == (n_a, n_b)
        out += [(min(x, y), max(x, y), dist) for x in groups[a] for y in groups[b] if a != b or x < y]
    assert len(out) == len(set(out))
    return set(out)


@pytest.fixture(scope="module")
def planted(spark):
    """Families of noisy copies, a black-first-frame flood, exact copies, short and empty lists."""
    rng = random.Random(3)
    word = lambda: rng.getrandbits(64)
    flip = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    hashes = {}
    for f in range(6):
        base = [word() for _ in range(8)]
        for j in range(5):
            hashes[f"f{f}_{j}"] = [flip(h, rng.choice([0, 3, 6, 7, 12])) for h in base]
    black = word()
    for j in range(40):
        hashes[f"black{j}"] = [black, black, black if j % 2 else word()] + [word() for _ in range(5)]
    for j in range(6):
        hashes[f"copy{j}"] = list(hashes["f0_0"])
    hashes["short"] = hashes["f1_0"][:4]
    hashes["two"] = hashes["f1_0"][:2]
    hashes["none"] = []
    rows = [(k, [signed(h) for h in v]) for k, v in hashes.items()]
    return {k: [signed(h) for h in v] for k, v in hashes.items()}, spark.createDataFrame(rows, "video_id string, phash array<bigint>")


def test_a_block_is_only_used_on_request(spark):
    a, b = [2**40, 5, 6, 7], [2**60, 5, 6, 7]
    df = spark.createDataFrame([("a", a), ("b", b)], "video_id string, phash array<bigint>")
    assert len(D.class_links(D.classes(df)).collect()) == 1
    assert D.class_links(D.classes(df, block_bits=16)).collect() == []


def test_common_frames_bring_no_pairs_together(spark):
    """Two frames that every clip has, and bands that many share: what is left of the keys grows with the links."""
    rng = np.random.default_rng(12)
    clips = {f"v{i}": [11, 22, *(int(x) for x in rng.integers(-(2**62), 2**62, 5))] for i in range(300)}
    for i in range(0, 20, 2):  # ten true pairs: three frames more or less alike
        clips[f"v{i + 1}"][4] = clips[f"v{i}"][4] ^ 5
    df = spark.createDataFrame([(k, v) for k, v in clips.items()], "video_id string, phash array<bigint>")
    got = {(r["rep_a"], r["rep_b"]) for r in D.near_duplicates(df).collect()}
    assert got == {tuple(sorted((f"v{i}", f"v{i + 1}"))) for i in range(0, 20, 2)}
    each = df.selectExpr("video_id AS rep", "0L AS block", "inline(flatten(transform(sequence(0, 6), p -> transform(sequence(0, 6), i -> struct(p, i, " + D._band("phash[p]", "i", 7) + " AS v, phash[p] AS h)))))")
    counted = each.groupBy("p", "i", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    left = D.rarest_first(each.join(counted, ["p", "i", "v"]), 3)
    assert left.where("p < 2").isEmpty() and left.agg(F.max("m")).first()[0] < 20


@pytest.mark.parametrize("hot_key", [2, 10, 500])
def test_near_duplicates_equal_brute_force(spark, planted, hot_key):
    """Hot keys are refined by a second position; no pair may get lost on the way."""
    hashes, df = planted
    want = brute(hashes)
    assert len(want) > 50
    assert expand(spark, df, hot_key) == want


def test_duplicates_are_classified_by_place(spark, planted):
    hashes, df = planted
    place = {k: ("a" if i % 3 else "b", "train" if i % 2 else "test") for i, k in enumerate(sorted(hashes))}
    m = spark.createDataFrame([(k, *v) for k, v in place.items()], "video_id string, dataset string, split string")
    want = {"split": 0, "dataset": 0}
    for a, b, _ in brute(hashes):
        if place[a][0] != place[b][0]:
            want["dataset"] += 1
        elif place[a][1] != place[b][1]:
            want["split"] += 1
    got = {r["kind"]: r["n"] for r in D.classify(df, m).groupBy("kind").agg(F.sum("n_pairs").alias("n")).collect()}
    assert got == want


def test_cross_dataset_duplicates_only_warn(spark):
    m = manifest(spark, {}, {"dataset": "dfdc", "split": "test"})
    h = spark.createDataFrame([("v0", [1, 2, 3]), ("v1", [1, 2, 3])], "video_id string, phash array<bigint>")
    row = MF.leak_report(m, D.classify(h, m)).first()
    assert row["ok"] and row["cross_dataset_duplicates"] == 1


# ---- layouts ---------------------------------------------------------------------------
def test_deeperforensics_layout_and_unknown_dataset(spark):
    paths = ["/r/source_videos/a/1_2.mp4", "/r/manipulated_videos/end_to_end_level_3/2_1.mp4", "/r/manipulated_videos/reenact/9.mp4", "/r/other/x.mp4"]
    m = S.parse_dataset("deeperforensics", spark.createDataFrame([(p,) for p in paths], "path string"))
    got = sorted((r["video_id"], r["forgery_method"], r["source_identity"]) for r in m.collect())
    assert got == [("dfo_end_to_end_level_3_2_1", "dfo_level3", "dfo_1+2"), ("dfo_real_1_2", "real", "dfo_1+2"), ("dfo_reenact_9", "dfo_reenact", "dfo_9")]
    with pytest.raises(KeyError, match="unknown dataset"):
        S.parse_dataset("nope")


def test_straddling_pairs_are_dropped(spark):
    splits = spark.createDataFrame([("0", "train"), ("1", "train"), ("2", "test")], "id string, split string")
    df = spark.createDataFrame([("a", ["0", "1"]), ("b", ["0", "2"]), ("c", ["0", "9"]), ("d", ["8", "9"])], "path string, ids array<string>")
    got = {r["path"]: r["split"] for r in S.official_split(df, splits).collect()}
    assert got == {"a": "train", "c": "train"}


# ---- samples ---------------------------------------------------------------------------
def test_balanced_sample_sizes_and_repeats(spark):
    m = manifest(spark, *[{"label": 0}] * 3, *[{"label": 1, "forgery_method": k} for k in "aabbbc"])
    got = {r["stratum"]: r["count"] for r in sampling.balanced_sample(m, 24).groupBy("stratum").count().collect()}
    assert got == {"real": 12, "fake:a": 4, "fake:b": 4, "fake:c": 4}
    per_row = [r["count"] for r in sampling.balanced_sample(m, 24).where("stratum = 'real'").groupBy("video_id").count().collect()]
    assert per_row == [4, 4, 4]
    assert sampling.balanced_sample(m.where("label = 1"), 4).count() == 4


def test_every_batch_has_sound(spark):
    m = manifest(spark, *[{"has_audio": i == 0} for i in range(20)])
    b = sampling.stratified_batches(m, 4).groupBy("batch").agg(F.count(F.when(F.col("has_audio"), 1)).alias("a"), F.count("*").alias("n"))
    assert sorted((r["batch"], r["a"], r["n"]) for r in b.collect()) == [(i, 1, 4) for i in range(5)]


def test_partners_form_one_ring(spark):
    m = manifest(spark, *[{}] * 7)
    nxt = {r["path"]: r["partner"] for r in MF.partner_paths(m).collect()}
    seen, p = set(), "/d/v0.mp4"
    while p not in seen:
        seen.add(p)
        p = nxt[p]
    assert len(seen) == 7
    assert MF.partner_paths(manifest(spark, {})).count() == 0


def test_domain_ids_stay_put(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, seq int")
    first = MF.domain_ids(df([("b", 0), ("a", 1), ("b", 2)]), "k", "seq")
    assert {r["value"]: r["id"] for r in first.collect()} == {"b": 0, "a": 1}
    more = MF.domain_ids(df([("c", 0), ("a", 1), ("d", 5)]), "k", "seq", first)
    assert {r["value"]: r["id"] for r in more.collect()} == {"b": 0, "a": 1, "c": 2, "d": 3}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rendered_clips_meet_their_manifest_without_a_broadcast(spark):
    m = manifest(spark, {"has_audio": True}, {}, {"label": 1})
    done = m.withColumn("recipe", F.explode(F.lit([*MF.RECIPES, "unasked"]))).where("NOT (recipe = 'hflip' AND video_id = 'v1')")
    out = MF.degrade_manifest(m, MF.RECIPES, done.withColumn("path", F.concat_ws("/", F.lit("/x"), "recipe", "video_id")))
    got = {tuple(r) for r in out.select("video_id", "path", "has_audio").collect()}
    assert got == {(f"v{i}__{r}", f"/x/{r}/v{i}", r != "audio_strip") for i in range(3) for r in MF.RECIPES if (i, r) != (1, "hflip")}
    assert out.count() == 3 * len(MF.RECIPES) - 1
    # The list of what was rendered is many times the table it is made from, which estimates do not see.
    plan = plan_of(out)
    assert "Broadcast" not in plan and plan.count("Generate explode") == 1


def test_bands_that_agree_by_chance_are_not_carried_on(spark, monkeypatch):
    """What is written per clip grows with its frames and links, however many clips share each band."""
    rng = np.random.default_rng(5)
    clips = [(f"v{i}", [int(x) for x in rng.integers(-(2**62), 2**62, 6)]) for i in range(3000)]
    clips[1][1][1:4] = [h ^ 9 for h in clips[0][1][1:4]]
    df = spark.createDataFrame(clips, "video_id string, phash array<bigint>")
    written = {}

    def cut(rows, name):
        out = new_path(rows.sparkSession, name)
        rows.write.parquet(out)
        back = rows.sparkSession.read.parquet(out)
        written.setdefault(name, []).append(back.count())
        return back

    monkeypatch.setattr(D, "cut", cut)
    got = [(r["rep_a"], r["rep_b"], r["n_frames"], r["distance"]) for r in D.near_duplicates(df, hot_key=4).collect()]
    assert got == [("v0", "v1", 3, 2)]
    assert max(n for counts in written.values() for n in counts) <= 3000 * 6 and max(written["keys"]) == 6
