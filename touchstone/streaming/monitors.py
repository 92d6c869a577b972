"""Live counters, histograms, drift and rate limits over result and upload streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.media import upload_policy
from ..operators import monitor as N
from ..session import new_path
from .tables import drain


def verdict_counts(stream: DataFrame) -> DataFrame:
    """Running counts per verdict, with abstentions and novelty flags beside."""
    return stream.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("verdict") == "inconclusive", 1)).alias("n_abstained"),
        F.count(F.when(F.col("ood_flag"), 1)).alias("n_ood"),
    )


def slot_counts(stream: DataFrame, value, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows per histogram slot, the streaming half of a cumulative histogram."""
    slot = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        slot = F.when(value <= edges[i], i).otherwise(slot)
    return stream.where(value.isNotNull()).groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("k"))


def cumulative(slots: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``le`` buckets from slot counts; a handful of rows per key."""
    every = [*edges, float("inf")]
    wide = slots.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col("slot") <= i, F.col("k"))), F.lit(0)).alias(f"b{i}") for i in range(len(every))]
    )
    return wide.select(*by, F.inline(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(every)])))


def stage_seconds(stream: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """One row per ``<stage>_ms`` entry of the latency map, in seconds."""
    long = stream.select(F.explode(latency).alias("stage", "ms"))
    return long.where(F.col("stage").endswith("_ms")).select(
        F.regexp_replace("stage", "_ms$", "").alias("stage"), (F.col("ms") / 1000.0).alias("seconds")
    )


def reject_counts(stream: DataFrame) -> DataFrame:
    return upload_policy(stream).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def rate_windows(stream: DataFrame, minutes: int = 1, late: str = "10 minutes", limit: int | None = None) -> DataFrame:
    """Requests per client and window, more than ``limit`` of them if given.

    In append mode a window comes once, when the watermark has passed its end, and its
    state goes; rows for a window that is gone are dropped and counted by the query
    (``tables.late_groups``).
    """
    counts = (
        stream.withWatermark("ts", late)
        .groupBy("client", F.window("ts", f"{minutes} minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if limit is not None:
        counts = counts.where(F.col("n") > limit)
    return counts.select("client", F.col("w.start").alias("start"), "n")


#: What a monitor keeps of one key: a window as arrays, newest first, and all-time counts.
KEPT = "ts array<bigint>, seq array<bigint>, a array<double>, b array<double>, total bigint, ood bigint, held bigint"


def observations(results: DataFrame | None, uploads: DataFrame | None, shards: int) -> DataFrame:
    """Results and uploads as rows of one stream: (kind, shard, ts, seq, a, b, ood, held).

    Kinds are ``score`` (only where there is a probability), ``row``, ``upload`` and
    ``codec``. The first three are dealt to shards by hash, so that no key is hot; a
    codec is its own shard.
    """

    def micros(df: DataFrame):
        return F.unix_micros("ts") if df.schema["ts"].dataType.typeName().startswith("timestamp") else F.col("ts").cast("bigint")

    def kinds(df: DataFrame, *rows) -> DataFrame:
        made = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("shard"), a.cast("double").alias("a"), b.cast("double").alias("b"), o.cast("int").alias("ood"), h.cast("int").alias("held"), f.alias("keep")) for k, s, a, b, o, h, f in rows])
        flat = df.select(micros(df).alias("ts"), F.col("seq").cast("bigint").alias("seq"), F.inline(made))
        return flat.where("keep").select("kind", "shard", "ts", "seq", "a", "b", "ood", "held")

    shard, no, yes = F.pmod(F.xxhash64("ts", "seq"), F.lit(shards)).cast("string"), F.lit(0), F.lit(True)
    parts = []
    if results is not None:
        audio, faces = F.coalesce(F.col("has_audio"), F.lit(False)), F.coalesce(F.col("n_faces_found"), F.lit(0))
        ood, held = F.coalesce(F.col("ood_flag"), F.lit(False)), F.coalesce(F.col("verdict") == "inconclusive", F.lit(False))
        parts.append(kinds(results, ("score", shard, F.col("calibrated_prob"), no, no, no, F.col("calibrated_prob").isNotNull()), ("row", shard, audio, faces, ood, held, yes)))
    if uploads is not None:
        parts.append(kinds(uploads, ("upload", shard, F.col("duration_s"), F.col("height"), no, no, yes), ("codec", F.col("codec"), no, no, no, no, F.col("codec").isNotNull())))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def newest_kept(rows: DataFrame, window: int) -> DataFrame:
    """Per (kind, shard): the newest ``window`` rows and all-time counts, held in Spark's state store.

    A key's state is bounded by ``window``. The newest rows of all shards together hold
    the newest of the stream.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, a, b, total, ood, held = state.get if state.exists else ([], [], [], [], 0, 0, 0)
        now = pd.DataFrame({"ts": ts, "seq": seq, "a": a, "b": b}).astype({"ts": "int64", "seq": "int64", "a": "float64", "b": "float64"})
        for part in parts:
            total, ood, held = total + len(part), ood + int(part["ood"].sum()), held + int(part["held"].sum())
            if key[0] != "codec":
                now = pd.concat([now, part[["ts", "seq", "a", "b"]]]).sort_values(["ts", "seq"], ascending=False, kind="stable").head(window)
        kept = [[int(v) for v in now["ts"]], [int(v) for v in now["seq"]], *[[None if v != v else float(v) for v in now[c]] for c in "ab"]]
        state.update((*kept, total, ood, held))
        yield pd.DataFrame([[*key, *kept, total, ood, held]], columns=["kind", "shard", "ts", "seq", "a", "b", "total", "ood", "held"])

    return rows.groupBy("kind", "shard").applyInPandasWithState(keep, f"kind string, shard string, {KEPT}", KEPT, "update", GroupStateTimeout.NoTimeout)


class DriftMonitor:
    """Rolling drift of results and uploads against a validation baseline.

    Windows of scores, of rows and of uploads are kept apart, in the state store, dealt
    over ``shards``. Micro-batches write what changed over a small table of the newest
    state per key, in turn to two places, so a batch that is run again finds the table
    before it. Give a fixed ``path`` to go on after a restart.
    """

    def __init__(self, baseline: DataFrame, window: int = N.WINDOW, n_bins: int = 10, path: str | None = None, shards: int = 16):
        self.baseline, self.window, self.n_bins, self.shards = baseline, window, n_bins, shards
        self.spark = baseline.sparkSession
        self.path = path or new_path(self.spark, "drift")

    def _place(self, version: int) -> str:
        return f"{self.path}/kept/v{version % 2}"

    def newest(self) -> int | None:
        """The last finished micro-batch, in this run or an earlier one."""
        done = []
        for place in (0, 1):
            try:
                done += [r["batch"] for r in self.spark.read.parquet(self._place(place)).select("batch").distinct().collect()]
            except AnalysisException:  # not written yet, or cut off
                continue
        return max(done, default=None)

    def on_batch(self, changed: DataFrame, batch: int) -> None:
        # Written once, so that the state store is asked once per batch.
        changed.write.mode("overwrite").parquet(f"{self.path}/changed")
        changed = self.spark.read.schema(changed.schema).parquet(f"{self.path}/changed")
        if batch > 0:
            before = self.spark.read.parquet(self._place(batch - 1)).drop("batch")
            changed = changed.unionByName(before.join(changed.select("kind", "shard"), ["kind", "shard"], "left_anti"))
        # At least one row says which batch this is, even if it brought none.
        mark = self.spark.range(1).select(F.lit("mark").alias("kind"), F.lit("").alias("shard"))
        changed = changed.where("kind <> 'mark'").unionByName(mark, allowMissingColumns=True)
        changed.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(self._place(batch))

    def run(self, results: DataFrame | None = None, uploads: DataFrame | None = None) -> DriftMonitor:
        kept = newest_kept(observations(results, uploads, self.shards), self.window)
        drain(kept, self.on_batch, "update", offsets=f"{self.path}/offsets")
        return self

    def kept(self, kind: str, a: str, b: str = "b") -> DataFrame:
        """The newest ``window`` rows of a kind, out of those of its shards."""
        rows = self.state().where(F.col("kind") == kind)
        flat = rows.select(F.inline(F.arrays_zip("ts", "seq", "a", "b"))).toDF("ts", "seq", a, b)
        return N.last_n(flat, ("ts", "seq"), self.window)

    def state(self) -> DataFrame:
        version = self.newest()
        if version is None:
            raise ValueError("nothing was observed yet: run a stream first")
        return self.spark.read.parquet(self._place(version))

    def report(self) -> DataFrame:
        """The report of the last version; reads at most ``window`` rows of each kind and shard."""
        state = self.state()
        rows = self.kept("row", "has_audio", "n_faces_found").withColumn("has_audio", F.col("has_audio") == 1).withColumn("n_faces_found", F.col("n_faces_found").cast("int"))
        sums = state.where("kind = 'row'").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", "ood", "held")])
        codecs = state.where("kind = 'codec'").select(F.col("shard").alias("codec"), F.col("total").alias("n"))
        return N.drift_of_windows(self.kept("score", "calibrated_prob"), rows, sums, self.baseline, self.kept("upload", "duration_s", "height"), codecs, self.n_bins)
