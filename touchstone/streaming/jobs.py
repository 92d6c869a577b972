"""Job change feeds: latest state, ordered progress, and training tails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import TERMINAL, job_state

PROGRESS = "job_id bigint, seq bigint, state string, stage string"
#: What is held of a job that may still change: its last pair, whether that ended it, and its newest time.
LIVE = {"job": "int64", "state": "object", "stage": "object", "over": "bool", "newest": "int64"}


def latest_state(changes: DataFrame) -> DataFrame:
    """Latest job fields as a streaming aggregate: the batch operator, unchanged."""
    return job_state(changes)


def progress_feed(
    changes: DataFrame, late: str = "10 minutes", keep: str = "1 day", idle: str = "7 days", at: str = "ts", shards: int = 256
) -> DataFrame:
    """State or stage changes per job, repeats left out, ending at a terminal state.

    The state per job is the last pair sent and whether it was terminal. It is dropped
    when the watermark is ``keep`` past a terminal change, or ``idle`` past the last one;
    until then, changes after the terminal one are ignored. A change that comes later
    opens the job anew. Rows behind the watermark, ``late`` after the newest, are lost.

    Jobs are dealt over ``shards`` by a hash of their id, and a batch folds all jobs of a
    shard at once: Python is called per shard, not per job. A shard holds its live jobs;
    a stream that goes on must keep its number of shards.
    """
    keep_ms, idle_ms = (int(pd.Timedelta(span).total_seconds() * 1000) for span in (keep, idle))

    def emit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        got = [] if state.hasTimedOut else [part.assign(new=True) for part in parts]
        if state.exists:
            held = pd.DataFrame(dict(zip(LIVE, state.get))).astype(LIVE)
            got.append(held.assign(new=False, updated_us=0, seq=0, no_seq=False))
        rows = got[0] if len(got) == 1 else pd.concat(got, ignore_index=True)
        # Per job: what is held, then its new changes in their order.
        rows = rows.iloc[np.lexsort([rows[k].to_numpy() for k in ("seq", "no_seq", "updated_us", "new", "job")])].reset_index(drop=True)
        job, new, over = (rows[k].to_numpy() for k in ("job", "new", "over"))
        pairs = [rows[k].fillna("").to_numpy(dtype=object) for k in ("state", "stage")]
        first = np.append(True, job[1:] != job[:-1])
        same = ~first & np.logical_and.reduce([np.append(False, v[1:] == v[:-1]) for v in pairs])
        starts, ends = np.flatnonzero(first), over.cumsum() - over
        ended = ends > np.repeat(ends[starts], np.diff(np.append(starts, len(job))))
        sent = rows[new & ~ended & ~same]
        if len(sent):
            ids = pd.Series(None if pd.isna(key[0]) else sent["job"], sent.index, "Int64")
            seq = sent["seq"].astype("Int64").mask(sent["no_seq"])
            yield pd.DataFrame({"job_id": ids, "seq": seq, "state": sent["state"], "stage": sent["stage"]})

        last = np.append(starts[1:], len(job)) - 1
        live = pd.DataFrame({"job": job[last], "state": pairs[0][last], "stage": pairs[1][last]})
        live["over"], live["newest"] = np.logical_or.reduceat(over, starts), np.maximum.reduceat(rows["newest"].to_numpy(), starts)
        until = live["newest"] + np.where(live["over"], keep_ms, idle_ms)
        stays = np.logical_or.reduceat(new, starts) | (until >= now)
        if not stays.any():
            state.remove()
            return
        state.update(tuple(live.loc[stays, k].tolist() for k in LIVE))
        state.setTimeoutTimestamp(max(int(until[stays].min()), now + 1))

    job, order = F.col("job_id").cast("bigint"), F.lit(2**63 - 1)
    rows = changes.withWatermark(at, late).select(
        F.when(job.isNotNull(), F.pmod(F.xxhash64(job), F.lit(shards))).alias("shard"), F.coalesce(job, F.lit(0)).alias("job"), "state", "stage",
        F.coalesce(F.col("state").isin(TERMINAL), F.lit(False)).alias("over"), F.coalesce(F.unix_millis(at), F.lit(0)).alias("newest"),
        F.coalesce("updated_us", order).alias("updated_us"), F.coalesce("seq", order).alias("seq"), F.col("seq").isNull().alias("no_seq"), at,
    )
    held = "job array<bigint>, state array<string>, stage array<string>, over array<boolean>, newest array<bigint>"
    return rows.groupBy("shard").applyInPandasWithState(emit, PROGRESS, held, "append", GroupStateTimeout.EventTimeTimeout)


def epoch_tail(epochs: DataFrame, run: str = "run") -> DataFrame:
    """Best value, its epoch and the newest epoch per run, kept as streaming state."""
    return epochs.where("val_auc IS NOT NULL").groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.max(F.struct("val_auc", (-F.col("epoch")).alias("e"))).alias("best"),
        F.max("epoch").alias("last"),
    )
