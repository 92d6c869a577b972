"""A total order over a table, kept by position, without any one-task step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: monotonically_increasing_id() holds the partition above and the row below this bit.
ROW_BITS = 33


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, by: Sequence, name: str = "at") -> DataFrame:
    """``df`` range-partitioned and sorted by ``by``, with the row's place as ``name``.

    Places rise along the order; their upper bits tell the partition. Name enough columns
    to settle ties, so that a task that runs again gives the same places.
    """
    return df.repartitionByRange(partitions(df), *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def sums_before(df: DataFrame, values: Sequence[str], at: str = "at") -> DataFrame:
    """Add ``<v>_before``, the sum over all earlier rows, for rows placed by ``ordered``.

    ``df`` must be stored, as it is read twice. Totals per partition are summed in one
    window of as many rows as there are partitions.
    """
    df = df.withColumn("_part", F.shiftright(at, ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select("_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    found = df.join(offsets, "_part").select(
        "*", *[(F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values]
    )
    return found.drop("_part", *[f"_o_{v}" for v in values])


def numbered(df: DataFrame, by: Sequence, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... in the order ``by``."""
    placed = cut(ordered(df, by).withColumn("_one", F.lit(1).cast("long")), "ordered")
    return sums_before(placed, ["_one"]).withColumnRenamed("_one_before", name).drop("_one", "at")
