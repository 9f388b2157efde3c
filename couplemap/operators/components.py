"""Connected components by alternating large-star and small-star rounds
(Kiveris et al. 2014) on an edge table.

large-star: every vertex links its larger neighbours to the smallest vertex
among itself and its neighbours; small-star: every vertex links its smaller
neighbours and itself to the smallest of them.  Both keep the components, and
the rounds end in stars around each component's smallest vertex.

A round is a ``groupBy.min`` (combined on the map side) and an equi-join of
the edges with these minima.  Vertices of very many edges (at most
``HUBS`` times the shuffle partitions, whatever the graph holds: a list of
bounded length) have their edges dealt over copies of their minimum, so a hub
fills no task.  No vertex's neighbourhood is gathered into one row.  Count and
checksum of a round's written edges tell when nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HUBS = 4
HUB_EDGES = 1024


def _with_minimum(edges: DataFrame, limit: int) -> DataFrame:
    """(u, v, m): the edges with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    copies = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("u").alias("hub"), copies.alias("copies")))
    dealt = edges.join(hubs, F.col("u") == F.col("hub"), "left").select(
        "u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    spread = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, copies).otherwise(F.lit(1)) - 1)).alias("copy"))
    return dealt.join(spread.hint("shuffle_hash"), ["u", "copy"]).select("u", "v", "m")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges (larger vertex first), with their count and checksum."""
    whole = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    out = cut_lineage(whole)
    return out, tuple(out.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(id), edges(src, dst) -> (id, component) with component = the
    smallest id of the component.  Ids must be comparable (long or string)."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, before = _written(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    while True:
        limit = max(HUB_EDGES, 2 * before[0] // (HUBS * parts))
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())  # u is the larger one
        small = _with_minimum(large, limit).select("v", "u", "m")
        small = small.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        rows, now = _written(small)
        if now == before:  # stars: a round leaves them as they are
            break
        before = now
    ids = vertices.select("id").distinct()
    return ids.join(rows, ids["id"] == rows["u"], "left").select("id", F.coalesce("v", "id").alias("comp"))
