"""Composed flows: history (and sources) in, map tables out.

logical  renames -> touches -> bulk filter -> Jaccard -> average linkage ->
         t-SNE -> routes, centroids, cities
semantic sources -> identifiers -> split / lower / stem -> tf-idf -> cosine ->
         1 - s -> BIRCH on the distance rows -> the same tail (heights and
         routes still come from the commits)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import history as H
from ..operators import similarity as S
from ..operators.clustering.average_linkage import average_linkage
from ..operators.clustering.birch import THRESHOLD_MATRIX, birch, distance_rows
from ..operators.embedding.tsne import neighbours, tsne
from ..sources.history import History
from ..session import cut_lineage
from ..sources.results import MapResult

COUPLINGS = ("logical", "semantic")


def _tail(history: History, touches: DataFrame, incidence: DataFrame, clusters: DataFrame,
          embedding: DataFrame, url: str | None = None, active_branch: str | None = None) -> MapResult:
    heights = H.file_heights(incidence)
    buildings = G.city_buildings(clusters, heights)
    cities = G.centroids_normalized(G.centroids(embedding, clusters))
    # a city without buildings is dropped; its routes are kept (it has none)
    cities = cities.join(buildings.select("label").distinct(), "label")
    routes = G.cluster_routes(incidence, clusters)
    commit_files = H.commit_files_outer(history.commits, touches)
    dates = H.file_dates(touches)
    hashes = H.hashes_newest_first(history.commits)
    meta = hashes.select(F.lit(url).cast("string").alias("url"), F.lit(active_branch).cast("string").alias("active_branch"),
                         "pos", "commit_id")
    return MapResult(cities, buildings, routes, commit_files, dates, meta)


def logical_map(history: History, remove_bulk: int = -1, n_iter: int = 1000, seed: int = 0,
                url: str | None = None, active_branch: str | None = None) -> MapResult:
    live = cut_lineage(H.live_files(history.files))
    touches = cut_lineage(H.current_touches(history, live))
    inc = cut_lineage(H.incidence_long(H.filter_bulk_commits(touches, remove_bulk)))
    items = inc.select("path").distinct()
    clusters = cut_lineage(average_linkage(items, S.jaccard_pairs(inc), incidence=inc))
    near = S.jaccard_pairs(inc, nearest=neighbours())  # all pairs are made again, but few leave their tiles
    emb = cut_lineage(tsne(items, near, "distance", n_iter=n_iter, seed=seed))
    return _tail(history, touches, inc, clusters, emb, url, active_branch)


def semantic_map(history: History, sources: DataFrame, remove_bulk: int = -1, n_iter: int = 1000,
                 seed: int = 0, stem: bool = True, mode: str = "ast", url: str | None = None,
                 active_branch: str | None = None) -> MapResult:
    """``mode`` "ast" reads Python sources like the reference (files that do
    not parse are left out); "regex" takes identifiers from any text."""
    live = cut_lineage(H.live_files(history.files))
    src = cut_lineage(sources.join(live, "path"))  # the corpus: the live files that could be read
    parsed = cut_lineage(T.parsed_sources(src, mode))
    weights = cut_lineage(S.tf_idf(T.word_counts(src, stem=stem, mode=mode), parsed))
    cos = cut_lineage(S.cosine_pairs(weights))
    items = parsed
    clusters = cut_lineage(birch(distance_rows(items, cos), THRESHOLD_MATRIX))
    dist = S.invert_similarity(S.cosine_pairs(weights, nearest=neighbours()))
    emb = cut_lineage(tsne(items, dist, "distance", n_iter=n_iter, seed=seed))
    touches = cut_lineage(H.current_touches(history, live))
    inc = cut_lineage(H.incidence_long(H.filter_bulk_commits(touches, remove_bulk)))
    return _tail(history, touches, inc, clusters, emb, url, active_branch)


def couplings_map(couplings: str | None, history: History, sources: DataFrame | None = None, **kw) -> MapResult:
    """Pick the flow by coupling type; default logical, anything else is an error."""
    if couplings is None or couplings == "logical":
        return logical_map(history, **kw)
    if couplings == "semantic":
        if sources is None:
            raise ValueError("semantic couplings need source texts")
        return semantic_map(history, sources, **kw)
    raise ValueError(f"unknown couplings {couplings!r}: logical or semantic")
