"""Bind the driver's test tables to the engine's logical inputs.

history        events:  commit = hour, file = user (renames v0 -> v1 -> v2 by
               date, deletions, filtered extensions), FIXTURES.md section 3
history_large  orders:  commit = order date, file = customer
basket_pairs   lineitem: commit = order, file = part
corpus         documents: path = 'doc_<id>', text
points         embeddings
urls           pages
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.indexing import dense_rank_of
from ..operators.history import live_files
from ..session import cut_lineage
from .history import History


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour_seq(ts: F.Column) -> F.Column:
    # hours since the epoch, computed on the zone-less value (no session zone involved)
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)


# Dates that cut the events table into three name generations (v0, v1, v2).
_GEN1 = "2024-01-11 00:00:00"
_GEN2 = "2024-01-21 00:00:00"


def events_history(spark: SparkSession, sf_dir: str) -> History:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    hour = F.date_trunc("hour", F.col("ts"))
    gen = (
        F.when(F.col("ts") < F.lit(_GEN1).cast("timestamp_ntz"), "0")
        .when(F.col("ts") < F.lit(_GEN2).cast("timestamp_ntz"), "1")
        .otherwise("2")
    )
    path = F.concat(
        F.lit("v"), gen, F.lit("/d"), (F.col("user_id") % 10).cast("string"),
        F.lit("/user_"), F.col("user_id").cast("string"),
        F.when(F.col("user_id") % 13 == 0, ".png").otherwise(".py"),
    )
    by_user_desc = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.select(
        "event_id", "user_id", "ts",
        _hour_seq(hour).alias("commit_seq"),
        F.date_format(hour, "yyyyMMddHH").alias("commit_id"),
        hour.alias("committer_ts"),
        path.alias("path"),
        F.row_number().over(by_user_desc).alias("rn_desc"),
    )
    mods = ev.select(
        "commit_seq", "commit_id", "committer_ts",
        F.col("event_id").alias("ord"),
        F.lag("path").over(by_user).alias("old_path"),
        F.when((F.col("rn_desc") == 1) & (F.col("user_id") % 17 == 0), None)
        .otherwise(F.col("path")).alias("new_path"),
        "rn_desc",
    )
    # the two per-user windows run once; every later use reads the table
    mods = cut_lineage(mods)
    files = mods.where((F.col("rn_desc") == 1) & F.col("new_path").isNotNull()).select(F.col("new_path").alias("path"))
    commits = mods.select("commit_seq", "commit_id", "committer_ts").distinct().withColumn(
        "committer_tz", F.lit("+00:00"))
    return History(commits, mods.select("commit_seq", "ord", "old_path", "new_path"), files)


def _plain_history(df: DataFrame, commit_seq: F.Column, commit_id: F.Column, ts: F.Column,
                   ord_: F.Column, path: F.Column) -> History:
    """History without renames or deletions: every (commit, item) row is a change."""
    rows = df.select(commit_seq.alias("commit_seq"), commit_id.alias("commit_id"),
                     ts.alias("committer_ts"), ord_.alias("ord"), path.alias("path"))
    mods = rows.select("commit_seq", "ord", F.col("path").alias("old_path"), F.col("path").alias("new_path"))
    commits = rows.select("commit_seq", "commit_id", "committer_ts").distinct().withColumn(
        "committer_tz", F.lit(None).cast("string"))
    files = rows.select("path").distinct()
    return History(commits, mods, files)


def orders_history(spark: SparkSession, sf_dir: str) -> History:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return _plain_history(
        o,
        F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long"),
        F.date_format(day, "yyyyMMdd"),
        F.col("o_orderdate"),
        F.col("o_orderkey"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")),
    )


def lineitem_history(spark: SparkSession, sf_dir: str) -> History:
    li = table(spark, sf_dir, "lineitem")
    return _plain_history(
        li,
        F.col("l_orderkey"),
        F.col("l_orderkey").cast("string"),
        F.col("l_shipdate"),
        F.col("l_orderkey") * 100 + F.col("l_linenumber"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sources(path, text).  A table of fewer files than cores
    (the test tables are one file of one row group, which one task would read
    alone) is dealt over the cores first."""
    d = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if len(d.inputFiles()) < cores:
        d = d.select("doc_id", "text").repartition(cores)
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), "text")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("vec_"), F.format_string("%05d", "vec_id")).alias("path"),
                    "embedding", "label")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def events_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts for the events history: every document is dealt by a hash
    to a live file (for the semantic map, whose corpus must be the history's
    files); the texts of a file are rows of their own."""
    paths = dense_rank_of(live_files(events_history(spark, sf_dir).files), "path", "slot")
    n = paths.select(F.count(F.lit(1)).alias("n")).scalar()
    docs = table(spark, sf_dir, "documents").select(F.pmod(F.xxhash64("doc_id", "text"), F.nullif(n, F.lit(0))).alias("slot"), "text")
    return docs.join(paths, "slot").select("path", "text")
