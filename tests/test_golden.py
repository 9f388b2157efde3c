"""End-to-end check of the logical path against the reference's saved results."""

import pytest

import golden
from couplemap.operators import graph as G
from couplemap.operators import history as H
from couplemap.operators import similarity as S
from couplemap.operators.clustering.average_linkage import average_linkage


def _check(spark, name, local_limit):
    if not golden.available(name):
        pytest.skip("reference result file not present")
    g = golden.load(name)
    rows = [(i, f) for i, (_, fs) in enumerate(g["commits"]) for f in fs]
    inc = spark.createDataFrame(rows, "commit_seq long, path string").distinct()
    heights = {r.path: r.height for r in H.file_heights(inc).collect()}
    assert all(heights[fn] == h for c in g["cities"] for fn, h in c["buildings"])
    cl = average_linkage(inc.select("path"), S.jaccard_pairs(inc), local_limit=local_limit)
    lab = {r.path: r.label for r in cl.collect()}
    got = {}
    for p, l in lab.items():
        got.setdefault(l, set()).add(p)
    want = {frozenset(fn for fn, _ in c["buildings"]) for c in g["cities"]}
    assert set(map(frozenset, got.values())) == want
    mine = {c["label"]: lab[c["buildings"][0][0]] for c in g["cities"]}
    routes = {(r.start, r.end, r.width) for r in G.cluster_routes(inc, cl).collect()}
    assert routes == {(mine[a], mine[b], w) for a, b, w in g["routes"]}


def test_small_golden_local_finish(spark):
    _check(spark, "small", 4096)


def test_small_golden_spark_rounds(spark):
    _check(spark, "small", 20)


def test_large_golden(spark):
    _check(spark, "large", 4096)
