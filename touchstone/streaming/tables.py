"""Running a stream to a table, and feeding tables as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut, new_path


#: Micro-batches of a table that is read back as a stream, whatever its size.
BATCHES = 4
#: Rows of a file of an arrival, at most about; more rows are written by more tasks.
FILE_ROWS = 250_000


def as_stream(df: DataFrame, order: str, n_files: int | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Write a table out in time ranges and read it back as a file stream.

    By default there are as many ranges as shuffle partitions, read in ``BATCHES``
    micro-batches. Each batch commits the state of every shuffle partition; if batches
    grew with the partitions, so would the commits with their square.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "feed")
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files_per_trigger = files_per_trigger or -(-n_files // BATCHES)
    df.repartitionByRange(n_files, order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_arrivals(df: DataFrame, arrival: str) -> DataFrame:
    """A file stream with one micro-batch per value of ``arrival``, in their order, null last.

    Files are written one arrival after another, as they would come in; a file stream takes
    the oldest first. All arrivals have equally many files, so that a batch is that many:
    about ``FILE_ROWS`` rows each in the largest one; smaller ones are filled up with files
    that hold no rows. Meant for feeds of a few batches.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "arrivals")
    rows, schema = cut(df, "arrivals"), df.drop(arrival).schema
    sizes = rows.groupBy(arrival).count().orderBy(F.col(arrival).asc_nulls_last()).collect()
    n_files = -(-max((r["count"] for r in sizes), default=1) // FILE_ROWS)
    empty = rows.where("false").drop(arrival).coalesce(1)
    for k, r in enumerate(sizes):
        part = rows.where(F.col(arrival).eqNullSafe(r[0])).drop(arrival)
        (part.repartition(n_files) if n_files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        if n_files > 1:
            for _ in range((k + 1) * n_files - len(spark.read.schema(schema).parquet(path).inputFiles())):
                empty.write.mode("append").parquet(path)
    if not sizes:
        empty.write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n_files).parquet(path)


def late_groups(query: StreamingQuery) -> int:
    """State keys that a query dropped because their rows came after the watermark.

    Counts the batches that the session remembers (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def drain(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], mode: str = "append", offsets: str | None = None
) -> StreamingQuery:
    """Process all that is available, one checkpointed micro-batch after another.

    Name ``offsets`` to take up a stream where an earlier run left it.
    """
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", offsets or new_path(stream.sparkSession, "offsets"))
        .foreachBatch(on_batch)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def final_counts(stream: DataFrame) -> DataFrame:
    """The end state of a streaming aggregate in complete mode.

    Each batch writes its own version; a batch that is run again writes the same one.
    """
    spark, out, seen = stream.sparkSession, new_path(stream.sparkSession, "counts"), []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/v{batch}")
        seen.append(batch)

    drain(stream, write, "complete")
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/v{max(seen)}")


def final_updates(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value per key of a streaming aggregate in update mode.

    Only changed keys are written per batch; the newest batch of a key wins.
    """
    spark, out, seen = stream.sparkSession, new_path(stream.sparkSession, "updates"), []
    rest = [k for k in stream.columns if k not in keys]

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        seen.append(batch)

    drain(stream, write, "update")
    if not seen:
        return spark.createDataFrame([], stream.select(*keys, *rest).schema)
    rows = spark.read.parquet(out).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*keys, "_v.*")


def appended(stream: DataFrame, query: list | None = None) -> DataFrame:
    """All rows of a stateless or append-mode stream; the query that ran is added to ``query``."""
    spark, out, seen = stream.sparkSession, new_path(stream.sparkSession, "rows"), []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        seen.append(batch)

    ran = drain(stream, write)
    if query is not None:
        query.append(ran)
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


