"""Streams that stop and go on, and sources that refuse or report bad input."""

import random

import pytest
from pyspark.sql import functions as F

from touchstone.functions import text as X
from touchstone.operators import monitor as N
from touchstone.operators import sampling as S
from touchstone.session import new_path
from touchstone.sources import files, logs
from touchstone.sources import predictions as P
from touchstone.sources import runs as RT
from touchstone.streaming import jobs as J
from touchstone.streaming import tables as T
from touchstone.streaming.monitors import DriftMonitor, rate_windows


def result_rows(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi, 1, 2).select(
        i.alias("ts"), i.alias("seq"), ((i % 100) / 100.0).alias("calibrated_prob"), (i % 2 == 0).alias("has_audio"),
        (i % 5).cast("int").alias("n_faces_found"), (i % 10 == 0).alias("ood_flag"),
        F.when(i % 4 == 0, "inconclusive").otherwise("likely_authentic").alias("verdict"),
    )


def upload_rows(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi, 1, 2).select(
        i.alias("ts"), i.alias("seq"), (i % 50 * 1.0).alias("duration_s"), (i * 7 % 720).cast("int").alias("height"),
        F.when(i % 17 > 0, F.concat(F.lit("codec"), (i % 7).cast("string"))).alias("codec"),
    )


def with_gaps(df):
    """Some results without a probability, audio or faces: rows, but no scores."""
    odd = F.col("seq") % 3 == 0
    return df.withColumns({c: F.when(odd, None).otherwise(F.col(c)) for c in ("calibrated_prob", "has_audio", "n_faces_found", "ood_flag", "verdict")})


@pytest.mark.parametrize("shards,window", [(16, 500), (1, 120)])
def test_drift_goes_on_after_a_restart(spark, shards, window):
    """Two runs over growing folders equal one batch report over all of it, in every column."""
    feeds, state = [new_path(spark, "feed"), new_path(spark, "uploads")], new_path(spark, "drift")
    base = N.drift_baseline(spark.createDataFrame([(i / 300, True) for i in range(300)], "video_score double, has_audio boolean"), source="val")
    rows = [lambda lo, hi: with_gaps(result_rows(spark, lo, hi)), lambda lo, hi: upload_rows(spark, lo, hi)]
    streams = lambda: [spark.readStream.schema(make(0, 1).schema).option("maxFilesPerTrigger", 1).parquet(feed) for make, feed in zip(rows, feeds)]
    monitor = lambda: DriftMonitor(base, path=state, shards=shards, window=window)
    for lo, hi in ((0, 400), (400, 900)):
        for make, feed in zip(rows, feeds):
            make(lo, hi).write.mode("append").parquet(feed)
        got = monitor().run(*streams()).report().first()
    want = N.drift_report(rows[0](0, 900), base, rows[1](0, 900), window=window).first()
    assert set(want.asDict()) == set(got.asDict())
    for k, v in want.asDict().items():
        assert got[k] == (pytest.approx(v) if isinstance(v, float) else v), k
    assert got["n_observed"] == min(window, 600) and len(got["codecs"]) == 5 and got["baseline_source"] == "val"
    assert monitor().state().where("size(ts) > " + str(window)).isEmpty()
    assert monitor().report().first() == got  # a restart without any run
    assert monitor().run(*streams()).report().first() == got  # and one without new rows


def test_drift_of_results_alone_and_of_uploads_alone(spark):
    base = N.drift_baseline(spark.createDataFrame([(0.5, True)], "video_score double, has_audio boolean"))
    feeds = [new_path(spark, "feed"), new_path(spark, "uploads")]
    result_rows(spark, 0, 60).write.parquet(feeds[0])
    upload_rows(spark, 0, 60).write.parquet(feeds[1])
    stream = lambda k, df: spark.readStream.schema(df.schema).parquet(feeds[k])
    row = DriftMonitor(base).run(stream(0, result_rows(spark, 0, 1))).report().first()
    assert row["ready"] and row["median_height_px"] is None and not row["codecs"]
    row = DriftMonitor(base).run(uploads=stream(1, upload_rows(spark, 0, 1))).report().first()
    assert not row["ready"] and row["n_observed"] == 0 and row["ood_rate"] == 0 and row["small_video_rate"] > 0


US = 1_000_000


def changes(spark, rows):
    """rows of (batch, job, minute, state, stage), as a stream of these batches."""
    out = [(b, job, m * 60 * US, k, state, stage) for k, (b, job, m, state, stage) in enumerate(rows)]
    df = spark.createDataFrame(out, "b int, job_id long, updated_us long, seq long, state string, stage string")
    return T.as_arrivals(df.withColumn("ts", F.timestamp_micros("updated_us")), "b")


def test_progress_feed_over_many_batches_and_its_state_ends(spark):
    """One job changes in four batches; what follows its end is ignored, and then forgotten."""
    rows = [
        (0, 1, 0, "queued", "a"), (0, 1, 1, "queued", "a"), (0, 2, 2, "running", "x"), (1, 1, 3, "running", "a"), (1, 1, 4, "running", "b"),
        (2, 1, 5, "running", "b"), (2, 1, 6, "done", "b"), (2, 1, 7, "running", "c"), (3, 1, 8, "done", "b"), (3, 2, 9, "running", "y"),
        (4, 3, 60, "queued", None), (5, 3, 61, "failed", "z"), (6, 4, 500, "queued", "q"), (7, 4, 501, "queued", "q"), (8, 1, 502, "queued", "again"),
    ]
    ran = []
    got = T.appended(J.progress_feed(changes(spark, rows), late="1 minute", keep="30 minutes", idle="3 hours"), ran)
    sent = {}
    for r in got.orderBy("seq").collect():
        sent.setdefault(r["job_id"], []).append((r["state"], r["stage"]))
    assert sent == {
        1: [("queued", "a"), ("running", "a"), ("running", "b"), ("done", "b"), ("queued", "again")], 2: [("running", "x"), ("running", "y")],
        3: [("queued", None), ("failed", "z")], 4: [("queued", "q")],
    }
    kept = [op.numRowsTotal for p in ran[0].recentProgress for op in p.stateOperators]
    assert max(kept) == 3 and kept[-1] == 2  # job 2 went idle, 3 ended; 4 and the new 1 are left
    assert len(ran[0].recentProgress) >= 9


def folded(rows, late, keep, idle):
    """What jobs send and keep, one change after another: (seqs sent, jobs left)."""
    sent, live, top, now = [], {}, None, 0
    for b in sorted({r[0] for r in rows}):
        batch = sorted((r for r in rows if r[0] == b), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3] is None, r[3] or 0))
        for _, job, ms, seq, state, stage in batch:
            pair, over, newest = live.get(job, (None, False, 0))
            if not over and pair != (new := (state or "", stage or "")):
                sent.append((job, seq, state, stage))
            live[job] = (pair if over else new, over or state in ("done", "failed", "cancelled"), max(newest, ms))
        touched = {r[1] for r in batch}
        live = {j: v for j, v in live.items() if j in touched or v[2] + (keep if v[1] else idle) >= now}
        top = max([top or 0, *(r[2] for r in batch)])
        now = max(now, top - late)
    return sent, {j for j, v in live.items() if v[2] + (keep if v[1] else idle) >= now}


@pytest.mark.parametrize("shards", [1, 5])
def test_progress_feed_folds_many_jobs_of_a_shard_at_once(spark, shards):
    """Calls and state go by shard; each of its jobs still has its own order, end and expiry."""
    draw, minute = random.Random(shards), 60_000
    ids = [None, 0, *range(2**60, 2**60 + 60)]
    rows = []
    for b in range(6):
        for _ in range(120):
            m = b * 60 + draw.randrange(1, 60)
            state = draw.choice(["queued", "running", "running", "running", None, "done"])
            rows.append((b, draw.choice(ids[b * 8 : b * 8 + 20]), m * minute, len(rows) + 2**60, state, draw.choice(["a", "b", None])))
    rows += [(2, 0, 150 * minute, None, "running", "last"), (7, 0, 3000 * minute, 1, "queued", "a")]
    draw.shuffle(rows)
    df = spark.createDataFrame([(b, job, ms * 1000, seq, state, stage) for b, job, ms, seq, state, stage in rows], "b int, job_id long, updated_us long, seq long, state string, stage string")
    ran = []
    feed = J.progress_feed(T.as_arrivals(df.withColumn("ts", F.timestamp_micros("updated_us")), "b"), late="1 minute", keep="30 minutes", idle="2 hours", shards=shards)
    got = [tuple(r) for r in T.appended(feed, ran).select("job_id", "seq", "state", "stage").collect()]
    want, left = folded(rows, minute, 30 * minute, 120 * minute)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[0] for r in want}) > 50
    assert left == {0}
    kept = [op.numRowsTotal for p in ran[0].recentProgress for op in p.stateOperators]
    assert max(kept) <= shards + 1 and kept[-1] == 1  # one more for changes without a job


def test_arrivals_of_several_files_come_as_one_batch_each(spark, monkeypatch):
    """Large arrivals are written by several tasks; small ones and those without a time take one batch as well."""
    monkeypatch.setattr(T, "FILE_ROWS", 100, raising=False)
    sizes = {3: 750, None: 20, 7: 1, 9: 800}
    df = spark.createDataFrame([(b, k) for b, n in sizes.items() for k in range(n)], "b int, k int")
    seen = []
    T.drain(T.as_arrivals(df, "b"), lambda rows, batch: seen.append((rows.count(), rows.select(F.input_file_name()).distinct().count())))
    assert [n for n, _ in seen] == [750, 1, 800, 20]
    assert [files for _, files in seen][:3] == [8, 1, 8]


def test_rate_windows_come_once_and_late_rows_are_counted(spark):
    minutes = [(0, "a", 0), (0, "a", 0), (0, "b", 0), (1, "a", 30), (2, "a", 60), (3, "a", 0), (3, "b", 61), (3, "b", 61), (4, "a", 90)]
    df = spark.createDataFrame(minutes, "b int, client string, m long").select("b", "client", F.timestamp_seconds(F.col("m") * 60 + 5).alias("ts"))
    ran = []
    got = T.appended(minute_windows(T.as_arrivals(df, "b")), ran)
    assert sorted((r["client"], r["start"].minute + 60 * r["start"].hour, r["n"]) for r in got.collect()) == [("a", 0, 2), ("a", 30, 1), ("a", 60, 1), ("b", 0, 1), ("b", 61, 2)]
    assert T.late_groups(ran[0]) == 1
    many = T.appended(minute_windows(T.as_arrivals(df, "b"), limit=1))
    assert many.count() == 2


def minute_windows(stream, limit=None):
    return rate_windows(stream, 1, "10 minutes", limit)


def test_streams_without_rows(spark):
    feed = new_path(spark, "feed")
    result_rows(spark, 0, 2).limit(0).write.parquet(feed)
    stream = lambda: spark.readStream.schema(result_rows(spark, 0, 1).schema).parquet(feed)
    assert T.appended(stream()).count() == 0
    assert T.final_counts(stream().groupBy("verdict").count()).count() == 0
    assert T.final_updates(stream().groupBy("verdict").count(), ["verdict"]).count() == 0
    base = N.drift_baseline(spark.createDataFrame([(0.5, True)], "video_score double, has_audio boolean"))
    with pytest.raises(ValueError, match="nothing was observed"):
        DriftMonitor(base, path=new_path(spark, "drift")).report()


def test_nothing_is_cut_off(spark):
    jobs = spark.range(1000).select(F.col("id").alias("job_id"), F.col("id").alias("created_us"), F.lit("queued").alias("state"))
    assert N.recent(jobs, 500).count() == 500 and N.queue_depth(jobs).first()[0] == 1000
    log = spark.createDataFrame([("r", "train.log", "CUDA out of memory\n" + "ok\n" * 20000)], "run string, name string, text string")
    assert X.divergence(log).first()["reason"] == "CUDA OOM"
    for n in (20, 100):
        clips = spark.range(n).select(F.col("id").cast("string").alias("video_id"), F.lit(True).alias("has_audio"))
        got = S.stratified_batches(clips, 32)
        assert got.count() == n and got.select("video_id").distinct().count() == n


def test_preds_without_contract_columns_are_refused(spark):
    path = new_path(spark, "preds")
    spark.createDataFrame([("a", 1)], "video_id string, label int").write.csv(path, header=True)
    with pytest.raises(ValueError, match="missing columns"):
        P.read_preds(spark, path)


def test_unknown_formats_and_roots_are_refused(spark):
    with pytest.raises(ValueError):
        logs.write_verdicts(spark.range(1), new_path(spark, "v"), "xlsx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.list_files(spark, "/no/such/folder").collect()


def test_no_runs_write_nothing(spark):
    empty = spark.createDataFrame([], "exp string, seed int, split string, is_breakdown boolean, n bigint, auc double, accuracy double, f1 double, eer double, ece double")
    assert RT.write_results(empty, new_path(spark, "out")) == []


def test_job_changes_keep_old_fields_and_skip_unknown_jobs(spark):
    base = spark.createDataFrame([(1, 0, 0, "queued", "a.mp4")], "job_id int, created_us long, updated_us long, state string, filename string")
    changes = spark.createDataFrame([(1, 5, 1, "running", None), (1, 9, 2, "done", None), (2, 3, 1, "done", "b")], "job_id int, updated_us long, seq int, state string, filename string")
    got = N.upsert_jobs(base, changes).collect()
    assert [(r["job_id"], r["created_us"], r["updated_us"], r["state"], r["filename"]) for r in got] == [(1, 0, 9, "done", "a.mp4")]
    kept, expired = N.purge(N.job_state(changes), 5 + 24 * 3_600_000_000)
    assert [r["job_id"] for r in expired.collect()] == [2] and [r["job_id"] for r in kept.collect()] == [1]


@pytest.mark.parametrize("parts", [3, 40])
def test_batches_of_a_table_do_not_grow_with_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        seen = []
        feed = T.as_stream(spark.range(0, 4000, 1, 7).withColumnRenamed("id", "ts"), "ts")
        T.drain(feed, lambda df, batch: seen.append(df.count()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(seen) == 4000 and len(seen) <= T.BATCHES


def test_a_prediction_file_in_parts_is_found_as_a_whole(spark):
    """Its first part may hold no rows at all; runs are still compared by seed."""
    root = new_path(spark, "tree")
    for seed, n in ((0, 500), (1, 5)):
        rows = spark.range(n).repartition(3).selectExpr("concat('v', id) AS video_id", "CAST(id % 2 AS INT) AS label", "'ffpp' AS dataset", "'real' AS forgery_method", "true AS has_audio", "id / 500 AS logit")
        empty = rows.where("false").coalesce(1)
        P.write_preds(empty.union(rows), f"{root}/m1/seed{seed}/preds_val.csv")
    found = RT.discover_preds(spark, root).collect()
    assert [(r["key"], r["path"].split("/m1/")[1]) for r in found] == [("m1/val", "seed0/preds_val.csv")]
    assert P.read_preds(spark, found[0]["path"]).count() == 500
