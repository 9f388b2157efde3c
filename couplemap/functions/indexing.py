"""Dense positions without funnelling rows through one task.

``row_number().over(Window.orderBy(...))`` moves every row into a single
partition.  These helpers range-partition and sort instead, and write the
result once, with each row's partition and its place in it.  The per-partition
counts (one row per partition) come from the written table and are added to
the rows of the same table, so counts and rows belong together however often
they are read.  Rows that tie in the order columns get different positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID = "__pid"
_MID = "__mid"


def _placed(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    """The rows in order, written with partition number and place."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def with_global_index(df: DataFrame, order: list, name: str = "idx", start: int = 0,
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) rank of each row by ``order``."""
    rows = _placed(df, order, num_partitions)
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so one task for the window and a broadcast are safe
    offsets = rows.groupBy(_PID).agg(F.count(F.lit(1)).alias("__cnt")).select(
        _PID, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    return (
        rows.join(F.broadcast(offsets), _PID)
        .withColumn(name, F.col("__off") + F.col(_MID) + F.lit(start))
        .drop(_PID, _MID, "__off")
    )


def with_group_index(df: DataFrame, group: list, order: list, name: str = "idx",
                     start: int = 0) -> DataFrame:
    """Add ``name`` = rank of each row inside its group, by ``order``.

    A group holding a third of all rows stays spread over its range
    partitions: rows are numbered inside (partition, group), and a group that
    goes on from earlier partitions adds their counts.  At most one group
    crosses each partition boundary, so these offsets are a short list."""
    rows = _placed(df, list(group) + list(order), None)
    keys = [f"__k{i}" for i in range(len(group))]
    rows = rows.withColumns({k: F.col(g) if isinstance(g, str) else g for k, g in zip(keys, group)})
    earlier = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("__cnt"))
        .select(F.col(_PID).alias("__p"), *[F.col(k).alias(f"_{k}") for k in keys], F.sum("__cnt").over(earlier).alias("__off"))
        .where(F.col("__off") > 0)
    )
    same = F.col(_PID) == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(_MID))
    return (
        rows.withColumn("__r", inside).join(F.broadcast(offsets), same, "left")
        .withColumn(name, (F.col("__r") - 1 + F.coalesce("__off", F.lit(0)) + F.lit(start)).cast("long"))
        .drop(_PID, _MID, "__r", "__p", "__off", *keys, *[f"_{k}" for k in keys])
    )


def dense_rank_of(df: DataFrame, col: str, name: str) -> DataFrame:
    """Table (col, name) with ``name`` = 0-based dense rank of distinct values."""
    return with_global_index(df.select(col).distinct(), [F.col(col)], name=name)
