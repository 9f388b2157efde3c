"""Cluster graph and city tables: routes, buildings, centroids, members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cooccurrence import DEFAULT_TILE, pair_rows


def cluster_routes(incidence: DataFrame, clusters: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """(start, end, width): commits shared by two clusters, both directions, width > 0.

    The (label, commit) cells are made distinct first, so a commit touching
    many files of one cluster counts once; labels sharing a commit pair up
    through the salted co-occurrence join."""
    lc = incidence.join(clusters.select("path", "label"), "path").select("commit_seq", "label").distinct()
    p = pair_rows(lc, "commit_seq", "label", tile=tile)
    w = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("width"))
    return w.select(F.col("a").alias("start"), F.col("b").alias("end"), "width").unionByName(
        w.select(F.col("b").alias("start"), F.col("a").alias("end"), "width"))


def undirected_routes(routes: DataFrame) -> DataFrame:
    """One route per unordered city pair (widths are symmetric)."""
    return routes.where(F.col("start") < F.col("end"))


def common_commits(incidence: DataFrame, clusters: DataFrame, label_a: int, label_b: int) -> DataFrame:
    """Commits shared by two given clusters (the set behind one route's width)."""
    lc = incidence.join(clusters.select("path", "label"), "path").select("commit_seq", "label")
    a = lc.where(F.col("label") == label_a).select("commit_seq")
    b = lc.where(F.col("label") == label_b).select("commit_seq")
    return a.intersect(b)


def city_buildings(clusters: DataFrame, heights: DataFrame) -> DataFrame:
    """(label, fileName, height): members with a height; members outside the
    matrix get no building, and a city without buildings disappears."""
    return clusters.join(heights, "path").select(
        "label", F.col("path").alias("fileName"), F.col("height").cast("long").alias("height"))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(label, path): the members of every cluster, long (a cluster may hold
    a third of all files, so its members are not gathered into one row)."""
    return clusters.select("label", "path").distinct()


def centroids(embedding: DataFrame, clusters: DataFrame) -> DataFrame:
    """(label, x, y): mean position of the members."""
    return embedding.join(clusters, "path").groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def centroids_normalized(cents: DataFrame) -> DataFrame:
    """Divide by the largest mean of each axis (NULL when that maximum is 0);
    the maxima are scalar sub-queries, not a join."""
    mx = cents.select(F.max("x")).scalar()
    my = cents.select(F.max("y")).scalar()
    return cents.select("label", F.try_divide(F.col("x"), mx).alias("x"), F.try_divide(F.col("y"), my).alias("y"))


def route_endpoints(routes: DataFrame, cities: DataFrame) -> DataFrame:
    """Routes with both cities' positions attached."""
    s = cities.select(F.col("label").alias("start"), F.col("x").alias("start_x"), F.col("y").alias("start_y"))
    e = cities.select(F.col("label").alias("end"), F.col("x").alias("end_x"), F.col("y").alias("end_y"))
    return routes.join(s, "start").join(e, "end")


def relabel_noise(clusters: DataFrame, join_clusterless: bool = True) -> DataFrame:
    """Noise (-1) stays one cluster, or each noise row gets -1, -2, ... by path."""
    if join_clusterless:
        return clusters
    from ..functions.indexing import with_global_index

    noise = clusters.where(F.col("label") == -1)
    rest = clusters.where(F.col("label") != -1)
    numbered = with_global_index(noise.select("path"), [F.col("path")], name="k", start=1)
    return rest.select("path", "label").unionByName(
        numbered.select("path", (-F.col("k")).cast("int").alias("label")))
