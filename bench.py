"""Benchmark: the logical map's steps 2-5 on the events history, plus a few
headline operators, at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS].  Prints one JSON line.

Each step is materialised (written to the checkpoint folder) so its time is
its own; every query runs over the whole tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from couplemap.session import cut_lineage, local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, cpus))
    from couplemap.operators import graph as G
    from couplemap.operators import history as H
    from couplemap.operators import similarity as S
    from couplemap.operators.clustering.average_linkage import average_linkage
    from couplemap.operators.embedding.tsne import tsne
    from couplemap.plans.registry import QUERIES
    from couplemap.sources import bindings as B

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM, Python workers (not timed)
    run(B.table(spark, sf_dir, "region"))

    h = B.events_history(spark, sf_dir)

    def step2():
        live = H.live_files(h.files)
        touches = cut_lineage(H.current_touches(h, live))
        inc = cut_lineage(H.incidence_long(touches))
        return touches, inc

    touches, inc = timed("step2_couplings", step2)
    pairs = timed("step3_distances", lambda: cut_lineage(S.jaccard_pairs(inc)))
    items = inc.select("path").distinct()
    clusters = timed("step4_clustering", lambda: cut_lineage(average_linkage(items, pairs)))

    def step5():
        emb = cut_lineage(tsne(items, pairs, "distance"))
        heights = H.file_heights(inc)
        run(G.city_buildings(clusters, heights))
        run(G.centroids_normalized(G.centroids(emb, clusters)))
        run(G.cluster_routes(inc, clusters))
        run(H.file_dates(touches))
        run(H.commit_files_outer(h.commits, touches))

    timed("step5_output", step5)
    steps = sum(times[k] for k in list(times))

    for key in ["resolve_renames", "coupled_pairs", "tf_idf", "stem_words", "cluster_dbscan", "cluster_ward", "cosine_vectors"]:
        timed(key, lambda key=key: run(QUERIES[key](spark, sf_dir)))

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "logical_map_steps_2_to_5",
        "value": round(steps, 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
