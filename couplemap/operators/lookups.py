"""Lookups a map user runs over the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_city(buildings: DataFrame, routes: DataFrame | None, label: int):
    """Files of one city sorted by name, and the routes that start or end there."""
    files = buildings.where(F.col("label") == label).orderBy("fileName")
    r = None if routes is None else routes.where((F.col("start") == label) | (F.col("end") == label))
    return files, r


def highlight_commit(buildings: DataFrame, touches: DataFrame, commit_id: str | None) -> DataFrame:
    """Flag the buildings a chosen commit touched; 'None' (or no commit) clears."""
    if commit_id is None or commit_id == "None":
        return buildings.withColumn("highlighted", F.lit(False))
    hit = touches.where(F.col("commit_id") == commit_id).select(F.col("path").alias("fileName")).distinct() \
        .withColumn("highlighted", F.lit(True))
    return buildings.join(hit, "fileName", "left").withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))


def filter_routes_by_width(routes: DataFrame, min_width: float) -> DataFrame:
    return routes.where(F.col("width") >= F.lit(min_width))


def max_route_width(routes: DataFrame) -> DataFrame:
    """Upper bound of the width slider (0 when there is no route)."""
    return routes.agg(F.coalesce(F.max("width"), F.lit(0).cast("long")).alias("max_width"))
