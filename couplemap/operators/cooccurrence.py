"""Pairs of items that share a group, counted (or weighted), without letting
one hot group run on one task.

A group (a commit, a word) of k items gives k(k-1)/2 pairs.  Groups larger
than ``tile`` items are cut into s = ceil(k / tile) shards by a hash of the
item; the pairs of a group are then produced by s(s+1)/2 independent tiles
(shard i x shard j, i <= j), each an equi-join key of its own, so a group
holding a third of all rows spreads over many tasks.  Partial aggregation on
(a, b) runs inside each tile's task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_TILE = 4096
BROADCAST_GROUPS = 1 << 20


def _sharded(df: DataFrame, group: str, item: str, tile: int, large: DataFrame, few: bool) -> DataFrame:
    """Give the rows of large groups a shard of their group, all others shard
    0 of 1.  The list of large groups holds at most rows / tile entries; it is
    broadcast when it is short, so hot groups are not shuffled to be split."""
    known = F.broadcast(large) if few else large
    return (
        df.join(known.withColumnRenamed(group, "__big"), F.col(group) == F.col("__big"), "left")
        .withColumn("__s", F.coalesce("__s", F.lit(1)))
        .withColumn("__sh", F.pmod(F.xxhash64(F.col(item)), F.col("__s")).cast("int"))
        .drop("__big")
    )


def pair_rows(df: DataFrame, group: str, item: str, carry: list[str] | None = None,
              tile: int = DEFAULT_TILE) -> DataFrame:
    """All (a, b) with a < b sharing ``group``, one row per shared group.

    ``carry`` columns of each side come out suffixed ``_a`` / ``_b``.
    The input must hold each (group, item) once.  It is written once; groups
    of more than ``tile`` items are counted from the written table, and tiled.
    Without such groups the plain self-join on the group gives the same rows."""
    carry = carry or []
    base = cut_lineage(df.select(group, item, *carry).where(F.col(group).isNotNull()))
    counts = base.groupBy(group).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > tile)
    large = cut_lineage(counts.select(group, F.ceil(F.col("k") / F.lit(tile)).cast("int").alias("__s")))
    n = large.count()
    if n == 0:
        return _plain_pairs(base, group, item, carry)
    return _tiled_pairs(_sharded(base, group, item, tile, large, n <= BROADCAST_GROUPS), group, item, carry)


def _orient(l: str, r: str, group_col, group: str, carry: list[str]) -> list:
    swap = F.col(l) > F.col(r)
    cols = [
        group_col.alias(group),
        F.when(swap, F.col(r)).otherwise(F.col(l)).alias("a"),
        F.when(swap, F.col(l)).otherwise(F.col(r)).alias("b"),
    ]
    for c in carry:
        cols.append(F.when(swap, F.col(f"{c}__r")).otherwise(F.col(f"{c}__l")).alias(f"{c}_a"))
        cols.append(F.when(swap, F.col(f"{c}__l")).otherwise(F.col(f"{c}__r")).alias(f"{c}_b"))
    return cols


def _plain_pairs(x: DataFrame, group: str, item: str, carry: list[str]) -> DataFrame:
    left = x.select(F.col(group).alias("__g"), F.col(item).alias("__l"), *[F.col(c).alias(f"{c}__l") for c in carry])
    right = x.select(F.col(group).alias("__g"), F.col(item).alias("__r"), *[F.col(c).alias(f"{c}__r") for c in carry])
    j = left.join(right, "__g").where(F.col("__l") < F.col("__r"))
    return j.select(*_orient("__l", "__r", F.col("__g"), group, carry))


def _tiled_pairs(x: DataFrame, group: str, item: str, carry: list[str]) -> DataFrame:
    left = x.select(
        F.col(group).alias("__g"), F.col("__sh").alias("__i"),
        F.explode(F.sequence(F.col("__sh"), F.col("__s") - 1)).alias("__j"),
        F.col(item).alias("__l"), *[F.col(c).alias(f"{c}__l") for c in carry])
    right = x.select(
        F.col(group).alias("__g"), F.col("__sh").alias("__j"),
        F.explode(F.sequence(F.lit(0), F.col("__sh"))).alias("__i"),
        F.col(item).alias("__r"), *[F.col(c).alias(f"{c}__r") for c in carry])
    j = left.join(right, ["__g", "__i", "__j"])
    # same shard: keep each unordered pair once; different shards: items differ
    j = j.where((F.col("__i") != F.col("__j")) | (F.col("__l") < F.col("__r")))
    return j.select(*_orient("__l", "__r", F.col("__g"), group, carry))


def predicted_pairs(df: DataFrame, group: str) -> DataFrame:
    """sum k(k-1)/2 over groups: the pair rows a self-join would emit."""
    k = df.groupBy(group).agg(F.count(F.lit(1)).alias("k"))
    return k.select(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("pair_rows"))
