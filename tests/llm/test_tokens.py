"""Token files, the SentencePiece scan, mixing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from touchstone.llm import mixing, pieces, queries, tokenfiles

SF = "/root/testdata/sf0.001"
WORDS, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def read(spark, sf=SF):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def library_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    return [np.array([*e.ids, 2], "<u4") for e in found]


def test_token_files_equal_the_library(spark):
    rows = read(spark)
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_token_files"](spark, SF).collect()}
    at = 0
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_word_memory_equals_the_library():
    rng = random.Random(4)
    parts = ["It's", "don't", "ABC", "É", "é", "İ", "Σ", "<|endoftext|>", "<|EndOfText|>", "a1b2", "...", "**", "'s", "\t", " ", "\x1c", "́", "ﬁ", "\n", " ", "  ", "x.,", "—", "你", "\x01"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)] + ["", " ", "\n"]
    words = tokenfiles.WordIds(WORDS)
    flat, counts = words.encode(pa.array([*texts, None]))
    assert counts[-1] == 0 and len(words.encode(pa.array([], pa.string()))[1]) == 0
    for t, a, b in zip(texts, np.split(flat, np.cumsum(counts)), library_ids(texts)):
        assert a.tolist() == b.tolist()[:-1], t


def test_token_files_of_odd_rows(spark, docs, empty):
    out = tokenfiles.write(docs, WORDS)
    rows = tokenfiles.read(spark, out)
    assert rows.count() == docs.count()
    assert rows.where("doc_id = 3").first()["ids"] == [2] == rows.where("doc_id = 2").first()["ids"]
    assert [r["doc_id"] for r in rows.orderBy("at").collect()] == [None, 0, 2, 3, 4, 5, 5, 6, 7, 9, 100]
    assert tokenfiles.read(spark, tokenfiles.write(empty, WORDS)).count() == 0


def best_by_hand(model, s):
    """Plain dynamic programming over all pieces: the largest sum of scores."""
    best = [0.0] + [-np.inf] * len(s)
    for end in range(1, len(s) + 1):
        for at in range(max(0, end - model.longest), end):
            score = model.score.get(s[at:end], (None,))[0]
            if score is None and end == at + 1:
                score = model.low
            if score is not None:
                best[end] = max(best[end], best[at] + score)
    return best[-1]


def made_up(rng, n):
    parts = ["the", " ", "  ", "ing", "\n", "é", "你", "\U0001f600", "thention", "x" * 30, "1234", ",", "   "]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk", [20, 50])
def test_chunk_matrices_and_traces_give_the_best_score(spark, chunk):
    model, rng = pieces.pieces(MODEL), random.Random(chunk)
    for _ in range(20):
        s = model.normal(made_up(rng, 60))
        whole, parts = None, []
        for at in range(0, len(s), chunk):
            size = min(chunk, len(s) - at)
            m = model.matrix(s[at : at + chunk + model.longest], size, at + chunk >= len(s))
            parts.append(m)
            whole = m if whole is None else pieces.times(whole, m)
        assert abs(whole[0, 0] - best_by_hand(model, s)) < 1e-3
        left = pieces.times(pieces.times(parts[0], parts[1]), parts[2]) if len(parts) > 2 else None
        right = pieces.times(parts[0], pieces.times(parts[1], parts[2])) if len(parts) > 2 else None
        assert left is None or np.allclose(left, right, equal_nan=True)


def test_best_path_equals_the_library_for_a_unigram_model():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = pieces.pieces(MODEL)
    for w in "hest ariear entebest international tokenization thingthation Gesellschaft ouvertement".split():
        mine = sum(model.value_of[i] for i in model.encode(model.normal(w)).tolist())
        # With n = 1 the library prunes; the first of several is its true best path.
        best = library.nbest_encode_as_pieces(w, 5)[0]
        assert abs(mine - sum(model.score[p.replace(pieces.SIGN, " ")][0] for p in best)) < 0.5


def test_whole_documents_equal_the_library(spark):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    rows = read(spark, "/root/testdata/sf0.01")[:400]
    rows += [(10**6 + i, made_up(rng, 60)) for i in range(60)] + [(2 * 10**6, "ab" * 700), (2 * 10**6 + 1, " " * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: library.encode(t) for i, t in rows}
    for chunk in (pieces.CHUNK, 40):
        got = {r["doc_id"]: r["ids"] for r in pieces.encode(frame, MODEL, chunk, merges=True).collect()}
        assert sum(got[i] != ids for i, ids in want.items()) == 0


def test_scan_of_giant_texts(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 4)
    rng, model = random.Random(9), pieces.pieces(MODEL)
    rows = [(i, made_up(rng, rng.choice([0, 3, 40, 400]))) for i in range(25)] + [(50, "ab" * 700), (51, " " * 300), (52, "word " * 400), (52, "word " * 400)]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=40)
    out = pieces.decode(got, MODEL).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    texts = dict(rows)
    for r in out:
        assert r["text"] == texts[r["doc_id"]]
        s = model.normal(r["text"])
        mine = sum(model.value_of[i] for i in r["ids"] if i not in model.byte_of)
        mine += model.low * sum(1 for c in s if c not in model.score)
        assert abs(mine - best_by_hand(model, s)) < 1e-3


def test_scan_of_odd_rows(docs, empty):
    rows = pieces.with_round_trip(pieces.encode(docs, MODEL, chunk=50), MODEL).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert pieces.encode(empty, MODEL).count() == 0


def targets_by_hand(sizes, most=3):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[k] for k in full)
        open_ = [k for k in names if k not in full]
        total = sum(weight[k] for k in open_)
        out = {k: most * sizes[k] if k in full else rest * weight[k] / total for k in names}
        over = {k for k in open_ if out[k] > most * sizes[k]}
        if not over:
            return out
        full |= over


def check_mix(docs):
    got = mixing.mix(docs).documents.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets_by_hand(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[k] - want[k]) <= 1 for k in want)
    return sorted(map(tuple, got), key=str)


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    assert check_mix(docs) == check_mix(docs.repartition(5))


def test_mix_of_uneven_sources(spark):
    rows = [(i, "w " * (i % 50), s) for i, s in enumerate(["a"] * 200 + ["b"] * 3 + ["ä"] * 40 + [None] * 9 + ["Z"] * 5)]
    rows += [(900, "", "empty"), (901, None, "empty"), (902, "one", "tiny"), (903, "w " * 9000, "long"), (903, "w " * 9000, "long")]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_schedule_spreads_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 600, "ab"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    plan = mixing.mix(docs)
    share = dict(plan.sources.select("sid", "target").collect())
    slots = [r["sid"] for r in plan.schedule.orderBy("slot").collect()]
    for n in (20, 50, 100):
        for sid, t in share.items():
            assert abs(slots[:n].count(sid) - n * t / sum(share.values())) <= 4


def test_mix_of_odd_rows(docs, empty):
    assert mixing.mix(docs).documents.count() == docs.count()
    check_mix(docs)
    assert mixing.mix(empty).documents.count() == 0


def test_pipeline_keeps_contracts(spark):
    frame, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secrets", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = frame.columns, [frame]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == columns and seen[-1].schema == frame.schema
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in seen]
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & ids[1].keys()) > 0.95 * len(good)
    assert ids[2].keys() <= ids[1].keys() and ids[3] == ids[2] and max(ids[4].values()) <= 3
    assert not seen[3].where("text RLIKE 'token = \"[0-9a-f]{20}'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF)
    assert Counter(r["doc_id"] for r in last.select("doc_id").collect()) == ids[4]


def test_pipeline_stages_take_odd_rows(spark, docs, empty):
    from pyspark.sql import functions as F

    for frame in (docs, empty):
        frame = frame.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).count()


def test_mixed_rows_keep_null_and_repeated_ids(spark):
    rows = [(None, "no id at all", None), (1, "first text of one", None), (1, "second text", None), (2, "", None), (3, None, None)]
    got = corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[:3]))
