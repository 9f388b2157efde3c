"""Positions on more rows than Spark's range sample holds, with a payload."""

from pyspark.sql import functions as F

from couplemap.functions.indexing import with_global_index, with_group_index


def _rows(spark, n=400_000):
    return spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("payload"),
                                 F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"))


def test_global_index(spark, tmp_path):
    out = str(tmp_path / "t")
    with_global_index(_rows(spark), [F.col("k")], num_partitions=8).write.parquet(out)
    got = spark.read.parquet(out)
    assert got.agg(F.countDistinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (400_000, 0, 399_999)
    late = got.alias("a").join(got.alias("b"), F.col("a.idx") + 1 == F.col("b.idx")).where("a.k >= b.k")
    assert late.count() == 0 and got.where(~F.startswith("payload", F.lit("payload"))).count() == 0


def test_group_index(spark, tmp_path):
    from pyspark.sql import Window

    out = str(tmp_path / "t")
    with_group_index(_rows(spark), ["g"], ["k"], start=1).write.parquet(out)
    got = spark.read.parquet(out)
    want = F.row_number().over(Window.partitionBy("g").orderBy("k"))
    assert got.count() == 400_000
    assert got.withColumn("want", want).where(F.col("want") != F.col("idx")).count() == 0
