"""Ward agglomeration on points, cut at a distance threshold (reference: 1).

Ward's merge cost of clusters A, B is sqrt(2 nA nB / (nA + nB)) * |cA - cB|,
which is reducible, so mutual nearest neighbours merge in parallel rounds
(``centres.agglomerate``) and the result is that of the serial method.  The
factor is at least 1, so a merge below the threshold needs centres closer than
the threshold: partners come from the exact radius search, never from all pairs.
Squared costs follow the recurrence that lists of partners need (``Link.weight``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.indexing import with_global_index
from ...session import cut_lineage
from ..neighbors import as_vectors
from .centres import Link, agglomerate, features_of, resolve_roots

THRESHOLD = 1.0  # fixed value of the reference


def ward_link(threshold: float) -> Link:
    def weight(na, nb):
        return 2.0 * na * nb / (na + nb)

    def cost(na, nb, sa, sb, d2):
        w = np.sqrt(weight(na, nb) * d2)
        return np.where(w < threshold, w, np.inf)

    return Link(cost, threshold, weight)


def ward(points: DataFrame, threshold: float = THRESHOLD, vec: str = "v") -> DataFrame:
    """points(path, v) -> (path, label)."""
    ids = cut_lineage(with_global_index(as_vectors(points, "path", vec).withColumnRenamed("id", "path"), [F.col("path")], name="id"))
    _, merges = agglomerate(features_of(ids), ward_link(threshold))
    assign = cut_lineage(resolve_roots(ids.select("id"), merges))
    ranks = with_global_index(assign.select("cid").distinct(), [F.col("cid")], name="label")
    return assign.join(ranks, "cid").join(ids.select("id", "path"), "id").select("path", F.col("label").cast("int"))
