"""Properties of the operators without a SQL oracle, and equivalences."""

import os

import numpy as np
from pyspark.sql import Window, functions as F

from couplemap.operators import similarity as S
from couplemap.operators.cooccurrence import pair_rows
from couplemap.session import cut_lineage
from couplemap.sources import bindings as B

SF = "/root/testdata/sf0.001"


def test_salted_pairs_equal_plain(spark):
    h = B.lineitem_history(spark, SF)
    inc = h.modifications.select(F.col("new_path").alias("path"), "commit_seq").distinct()
    a = {tuple(r) for r in S.coupled_pairs(inc, tile=1 << 30).collect()}
    b = {tuple(r) for r in S.coupled_pairs(inc, tile=2).collect()}
    assert a == b and len(a) > 0


def test_salted_pairs_hot_group(spark):
    rows = [(0, f"f{i:03d}") for i in range(60)] + [(1, "f000"), (1, "f001")]
    df = spark.createDataFrame(rows, "commit_seq long, path string")
    p = pair_rows(df, "commit_seq", "path", tile=7).groupBy("a", "b").count()
    got = {(r.a, r.b): r["count"] for r in p.collect()}
    assert len(got) == 60 * 59 // 2 and got[("f000", "f001")] == 2


def _points(spark):
    return B.points(spark, SF).select("path", F.col("embedding").cast("array<double>").alias("v"))


def test_dbscan_matches_brute_force(spark):
    from couplemap.operators.clustering.dbscan import dbscan_points
    pts = _points(spark)
    lab = {r.path: r.label for r in dbscan_points(pts, 1.15, 2).collect()}
    pdf = pts.toPandas().sort_values("path")
    X = np.stack(pdf.v.to_numpy())
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    adj = D <= 1.15
    n = len(X)
    comp = list(range(n))
    for i in range(n):
        for j in range(n):
            if adj[i, j] and i != j:
                a, b = comp[i], comp[j]
                if a != b:
                    comp = [a if c == b else c for c in comp]
    paths = pdf.path.tolist()
    deg = adj.sum(1)
    for i in range(n):
        for j in range(n):
            if i != j and deg[i] > 1 and deg[j] > 1:
                assert (comp[i] == comp[j]) == (lab[paths[i]] == lab[paths[j]])
        assert (lab[paths[i]] == -1) == (deg[i] == 1)


def _radius(X, rows):
    return np.sqrt(((X[rows] - X[rows].mean(0)) ** 2).sum(1).mean())


def test_birch(spark):
    """Same subclusters from 1 and 8 partitions, dense and sparse; radii within
    the threshold, and no two near subclusters that could merge."""
    from couplemap.operators.clustering.birch import birch
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 1, (12, 6))[rng.integers(0, 12, 400)] + rng.normal(0, 0.08, (400, 6)), np.ones((20, 6)), [[9.0] * 6]])
    df = spark.createDataFrame([(f"p{i:04d}", x.tolist()) for i, x in enumerate(X)], "path string, v array<double>")
    sparse = df.select("path", F.struct(F.expr("transform(sequence(0, 5), i -> i * 70000)").alias("idx"), F.col("v").alias("val")).alias("v"))
    found = []
    for points in (df.repartition(1), df.repartition(8), sparse):
        found.append({r.path: r.label for r in birch(points, threshold=0.5, leaf=40).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == len(X)
    groups = {}
    for i in range(len(X)):
        groups.setdefault(found[0][f"p{i:04d}"], []).append(i)
    groups = list(groups.values())
    assert 5 < len(groups) < 200 and all(_radius(X, g) <= 0.5 + 1e-9 for g in groups)
    for i, a in enumerate(groups):
        for b in groups[:i]:
            if np.linalg.norm(X[a].mean(0) - X[b].mean(0)) <= 1.0:
                assert _radius(X, a + b) > 0.5 - 1e-9


def test_birch_distance_rows(spark):
    """Distances between sparse similarity rows are those between dense
    distance rows."""
    from couplemap.operators.clustering.birch import distance_rows
    from couplemap.operators.neighbors import radius_pairs
    items = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    s = {("a", "b"): 0.9, ("a", "c"): 0.2, ("d", "e"): 0.5}
    pairs = spark.createDataFrame([(*k, v) for k, v in s.items()], "a string, b string, similarity double")
    D = np.ones((5, 5)) - np.eye(5)
    for (a, b), v in s.items():
        D["abcde".index(a), "abcde".index(b)] = D["abcde".index(b), "abcde".index(a)] = 1 - v
    got = {(r.a, r.b): r.dist for r in radius_pairs(distance_rows(items, pairs), 9.0).collect()}
    assert len(got) == 10
    for (a, b), d in got.items():
        assert abs(d - np.linalg.norm(D["abcde".index(a)] - D["abcde".index(b)])) < 1e-9


def test_ward_equals_serial(spark):
    from couplemap.operators.clustering.ward import ward
    rng = np.random.default_rng(9)
    X = rng.normal(0, 1, (90, 4))
    df = spark.createDataFrame([(f"p{i:04d}", x.tolist()) for i, x in enumerate(X)], "path string, v array<double>")
    got = {}
    for r in ward(df, 2.0).collect():
        got.setdefault(r.label, set()).add(int(r.path[1:]))
    parts = [[i] for i in range(len(X))]
    while True:
        best = min(((np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(X[a].mean(0) - X[b].mean(0)), i, j)
                    for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j), default=(9e9, 0, 0))
        if best[0] >= 2.0:
            break
        parts[best[1]] += parts.pop(best[2])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts)) and len(parts) < 60


def test_ward_threshold(spark):
    from couplemap.operators.clustering.ward import ward
    pts = _points(spark)
    lab = {r.path: r.label for r in ward(pts, threshold=1.15).collect()}
    pdf = pts.toPandas()
    X = {p: np.array(v) for p, v in zip(pdf.path, pdf.v)}
    groups = {}
    for p, l in lab.items():
        groups.setdefault(l, []).append(p)
    cents = {l: (len(ps), np.mean([X[p] for p in ps], 0)) for l, ps in groups.items()}
    ls = list(cents)
    for i in range(len(ls)):
        for j in range(i + 1, len(ls)):
            (na, ca), (nb, cb) = cents[ls[i]], cents[ls[j]]
            assert np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(ca - cb) >= 1.15 - 1e-9


def test_average_linkage_cut(spark):
    """No two final clusters have mean similarity above 0.05."""
    from couplemap.operators.clustering.average_linkage import average_linkage
    from couplemap.plans.registry import _Hist
    x = _Hist(spark, SF)
    pairs = S.jaccard_pairs(x.inc)
    lab = {r.path: r.label for r in average_linkage(x.heights.select("path"), pairs).collect()}
    w, size = {}, {}
    for l in lab.values():
        size[l] = size.get(l, 0) + 1
    for r in pairs.collect():
        la, lb = lab[r.a], lab[r.b]
        if la != lb:
            k = (min(la, lb), max(la, lb))
            w[k] = w.get(k, 0.0) + r.similarity
    assert all(v / (size[a] * size[b]) <= 0.05 + 1e-12 for (a, b), v in w.items())


def _kl(P, Y):
    d2 = ((Y[:, None] - Y[None]) ** 2).sum(-1)
    Q = 1 / (1 + d2)
    np.fill_diagonal(Q, 0)
    Q /= Q.sum()
    return float((P[P > 0] * np.log(P[P > 0] / Q[P > 0])).sum())


def test_tsne(spark):
    """The divergence falls, neighbours are kept, several blocks do about as
    well as one, and items without pairs have a place."""
    from couplemap.operators.embedding import tsne as T
    rng = np.random.default_rng(2)
    n = 120
    group = rng.integers(0, 6, n)
    names = [f"p{i:03d}" for i in range(n)]
    rows = [(names[i], names[j], float(0.1 + 0.5 * rng.random())) for i in range(n) for j in range(i + 1, n) if group[i] == group[j] and i > 2]
    items = spark.createDataFrame([(p,) for p in names], "path string")
    pairs = spark.createDataFrame(rows, "a string, b string, distance double")
    ids = T.indexed(items)
    p = T.affinities(ids, T.id_pairs(ids, pairs, "distance"), n, 5.0, 0).toPandas()
    P = np.zeros((n, n))
    P[p.i, p.j] = p.p
    assert abs(P.sum() - 1) < 1e-9 and np.allclose(P, P.T) and ((P > 0).sum(1) >= 16).all()
    kl = []
    for kw in ({"n_iter": 4}, {"n_iter": 600}, {"n_iter": 600, "block": 20}):
        out = T.tsne(items, pairs, **kw).toPandas().sort_values("path")
        Y = out[["x", "y"]].to_numpy()
        assert out.path.tolist() == names and np.isfinite(Y).all()
        kl.append(_kl(P, Y))
    assert kl[1] < 0.6 * kl[0] and kl[2] < 0.75 * kl[0]
    d2 = ((Y[3:, None] - Y[None, 3:]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1)[:, :5]
    assert np.mean(group[3:][near] == group[3:, None]) > 0.8


def test_tsne_small(spark):
    from couplemap.operators.embedding.tsne import tsne
    for n in (0, 1, 2, 3):
        items = spark.createDataFrame([(f"p{i}",) for i in range(n)], "path string")
        pairs = spark.createDataFrame([("p0", "p1", 0.5)] if n > 1 else [], "a string, b string, distance double")
        out = tsne(items, pairs, n_iter=20).toPandas()
        assert len(out) == n and np.isfinite(out[["x", "y"]].to_numpy(dtype=float)).all()


def test_grid_potentials():
    """Forces read from the grid against the sum over all pairs."""
    import pandas as pd

    from couplemap.operators.embedding import tsne as T
    rng = np.random.default_rng(1)
    Y = rng.normal(0, 6, (300, 2))
    grid = T.Grid((Y[:, 0].min(), Y[:, 0].max(), Y[:, 1].min(), Y[:, 1].max()), T.MARGIN)
    at = (Y - np.array(grid.origin)) / grid.h
    c = np.floor(at).astype(int)
    t, u = (at - c).T
    charges = {"cx": c[:, 0], "cz": c[:, 1]}
    for name, v in (("w", 1.0), ("a", Y[:, 0]), ("b", Y[:, 1])):
        for k, w in enumerate(((1 - t) * (1 - u), t * (1 - u), (1 - t) * u, t * u)):
            charges[f"{name}{k}"] = w * v
    fields, z = grid.potentials(pd.DataFrame(charges).groupby(["cx", "cz"], as_index=False).sum())
    q = T._kernel(Y, Y)
    assert abs(z - q.sum()) < 0.02 * q.sum()
    a, b0, b1 = grid.read(fields, Y)
    got = a[:, None] * Y - np.column_stack([b0, b1])
    want = T._push(q * q, Y, Y)
    assert np.abs(got - want).max() < 0.05 * np.abs(want).max()
    far = np.array([[500.0, -300.0]])  # outside of the grid
    a, b0, b1 = grid.read(fields, far)
    assert np.allclose(a[0] * far[0] - [b0[0], b1[0]], T._push(T._kernel(far, Y) ** 2, far, Y)[0], rtol=0.05)


def test_with_group_index(spark):
    from couplemap.functions.indexing import with_group_index
    rows = [("a", f"p{i:02d}") for i in range(30)] + [("b", "q1"), ("b", "q0")]
    df = spark.createDataFrame(rows, "g string, p string")
    got = {(r.g, r.p): r.i for r in with_group_index(df, ["g"], [F.col("p")], name="i").collect()}
    assert got[("a", "p00")] == 0 and got[("a", "p29")] == 29 and got[("b", "q0")] == 0 and got[("b", "q1")] == 1


def test_radius_pairs_against_all_pairs(spark):
    import numpy as np

    from couplemap.operators.neighbors import radius_pairs

    rng = np.random.default_rng(4)
    dense = rng.normal(0, 0.05, (300, 5))
    far = rng.normal(0, 1.0, (60, 5))
    pts = np.vstack([dense, far, [[0.5, 0, 0, 0, 0]], dense[:3]])
    df = spark.createDataFrame([(f"p{i:04d}", [float(x) for x in v]) for i, v in enumerate(pts)], "path string, v array<double>")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for eps, strict in ((0.4, False), (0.4, True), (0.0, False)):
        want = {(f"p{i:04d}", f"p{j:04d}") for i in range(len(pts)) for j in range(i + 1, len(pts)) if (d[i, j] < eps if strict else d[i, j] <= eps)}
        assert {(r.a, r.b) for r in radius_pairs(df, eps, strict=strict, tile=40).collect()} == want
    assert radius_pairs(df.limit(0), 0.4).collect() == []


def test_pair_rows_hot_group(spark):
    from couplemap.operators.cooccurrence import pair_rows

    rows = [(1, f"i{k}") for k in range(50)] + [(2, "i1"), (2, "i2"), (None, "i3"), (None, "i4")]
    df = spark.createDataFrame(rows, "g long, x string")
    plain = sorted(tuple(r) for r in pair_rows(df, "g", "x").collect())
    assert len(plain) == 50 * 49 // 2 + 1
    assert sorted(tuple(r) for r in pair_rows(df, "g", "x", tile=7).collect()) == plain


def test_metric_tree(spark):
    """Clustered 64-d points: exact pairs, few distances; equal points and one
    large leaf end; sparse vectors give the same."""
    from couplemap.operators.neighbors import compared_pairs, radius_pairs
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (30, 64))
    X = np.concatenate([centres[rng.integers(0, 30, 1500)] + rng.normal(0, 0.15, (1500, 64)), np.repeat(centres[:1], 200, 0)])
    df = spark.createDataFrame([(f"p{i:05d}", x.tolist()) for i, x in enumerate(X)], "path string, v array<double>")
    D = np.sqrt(np.maximum((X * X).sum(1)[:, None] + (X * X).sum(1) - 2 * X @ X.T, 0))
    want = int((D[np.triu_indices(len(X), 1)] <= 1.8).sum())
    assert radius_pairs(df, 1.8, tile=100).count() == want
    seen = compared_pairs(df, 1.8, tile=100).first()
    assert seen.points == len(X) and seen.compared < 0.2 * len(X) ** 2
    few = df.limit(300)
    sparse = few.select("path", F.struct(F.expr("transform(sequence(0, 63), i -> i * 9000)").alias("idx"), F.col("v").alias("val")).alias("v"))
    assert sorted(map(tuple, radius_pairs(few, 1.8, tile=50).select("a", "b").collect())) == sorted(map(tuple, radius_pairs(sparse, 1.8, tile=50).select("a", "b").collect()))


def _components(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def test_components(spark):
    from couplemap.operators.components import connected_components
    rng = np.random.default_rng(3)
    cases = [(6, []), (5, [(1, 1)]), (400, [(i, i + 1) for i in range(399)]), (2000, [tuple(map(int, e)) for e in rng.integers(0, 2000, (1300, 2))]),
             (5000, [(0, i) for i in range(1, 4000)] + [(4500, i) for i in range(3990, 4400)])]
    for n, edges in cases:
        df = spark.createDataFrame(edges, "src long, dst long")
        assert {r.id: r.comp for r in connected_components(spark.range(n), df).collect()} == _components(n, edges)


def test_components_deal_a_hub_out(spark):
    """The join that meets a star's hub spreads its edges."""
    from couplemap.operators.components import _with_minimum
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = _with_minimum(both, 2 * 100_000 // (4 * 8))
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert sum(per) == 200_000 and max(per) <= 3 * sorted(per)[len(per) // 2]


def test_overlapping_cities_one_huge(spark):
    """A huge city among many small ones, against all pairs of a small grid;
    the small ones do not meet on the huge one's level."""
    from couplemap.operators.layout import OVERLAP_PAD, overlapping_cities
    rng = np.random.default_rng(6)
    rows = [(0, 0.0, 0.0, 1e6, 1e6)] + [(i, *map(float, rng.uniform(-5e3, 5e3, 2)), *map(float, rng.choice([10.0, 40.0, 900.0], 2))) for i in range(1, 400)] + [(500, 7.0, 7.0, 0.0, 0.0)]
    pos = spark.createDataFrame(rows, "label long, pos_x double, pos_z double, ground_width double, ground_length double")
    p = OVERLAP_PAD
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] - p < b[1] + b[3] and b[1] < a[1] + a[3] + p and a[2] - p < b[2] + b[4] and b[2] < a[2] + a[4] + p}
    got = [tuple(r) for r in overlapping_cities(pos).collect()]
    assert set(got) == want and len(got) == len(want)
    small = spark.range(1, 50_001).select(
        F.col("id").alias("label"), (F.col("id") % 250 * 100).cast("double").alias("pos_x"), F.floor(F.col("id") / 250).cast("double").alias("pos_z") * 100,
        F.lit(30.0).alias("ground_width"), F.lit(30.0).alias("ground_length")).toDF("label", "pos_x", "pos_z", "ground_width", "ground_length")
    many = small.unionByName(pos.where("label = 0"))
    assert overlapping_cities(many).where("i = 0").count() == 50_000


def test_cosine_above_and_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{i:02d}", f"w{j}", float(w)) for i in range(60) for j, w in zip(rng.choice(40, 8, replace=False), rng.exponential(1.0, 8)) if i != 7]
    rows += [("p07", "alone", 1.0), ("p61", "w1", 0.0)]
    df = spark.createDataFrame(rows, "path string, word string, w double")
    full = {(r.a, r.b): r.similarity for r in S.cosine_pairs(df).collect()}
    for t in (0.2, 0.6, 0.99):
        got = {(r.a, r.b): r.similarity for r in S.cosine_pairs(df, minimum=t).collect()}
        assert got.keys() == {k for k, v in full.items() if v >= t} and all(abs(got[k] - full[k]) < 1e-12 for k in got)
    near = {}
    for (a, b), v in full.items():
        near.setdefault(a, []).append((-round(v, 9), b))
        near.setdefault(b, []).append((-round(v, 9), a))
    want = sorted((p, k + 1, other) for p, rest in near.items() for k, (_, other) in enumerate(sorted(rest)[:3]))
    for start in (0.1, 0.9):
        assert sorted((r.path, r["rank"], r.other) for r in S.cosine_top_k(df, 3, start=start).collect()) == want


def test_mca_equals_the_dense_decomposition(spark):
    from couplemap.operators.embedding.mca import mca
    rng = np.random.default_rng(12)
    Z = (rng.random((50, 30)) < np.where(rng.integers(0, 2, 50)[:, None] == rng.integers(0, 2, 30)[None, :], 0.6, 0.1)).astype(float)
    Z[:, 0], Z[0] = 1.0, 1.0  # a commit of all files says nothing
    inc = spark.createDataFrame([(f"p{i:02d}", int(k)) for i, k in zip(*np.nonzero(Z))], "path string, commit_seq long")
    f = Z.mean(0)
    use = (f > 0) & (f < 1)
    X = (Z[:, use] - f[use]) / np.sqrt(f[use] * (1 - f[use]))
    u, s, _ = np.linalg.svd(X, full_matrices=False)
    want = u[:, :2] * s[:2] / np.sqrt(use.sum())
    got = np.array([[r.x, r.y] for r in mca(inc).orderBy("path").collect()])
    for k in range(2):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-3


def test_tiles_equal_the_joins(spark, monkeypatch):
    """Blocks of a few items: counts, cosines and the nearest rows by tiles
    are those of the joins, also with copies (ties) and a word in every row."""
    rng = np.random.default_rng(21)
    rows = [(f"p{i:02d}", f"w{j}", float(w)) for i in range(40) for j, w in zip(rng.choice(60, 6, replace=False), rng.exponential(1.0, 6))]
    rows += [(f"p{i:02d}", "all", 0.3) for i in range(40)] + [(f"c{i}", w, 1.0) for i in range(12) for w in ("w1", "all")] + [("q", "lone", 1.0), ("z", "all", 0.0)]
    df = spark.createDataFrame(rows, "path string, word string, w double")
    inc = df.select("path", F.crc32(F.col("word").cast("binary")).alias("commit_seq"))

    def every(block):
        pairs = {(r.a, r.b): round(r.similarity, 9) for r in S.cosine_pairs(df, block=block).collect()}
        above = {(r.a, r.b): round(r.similarity, 9) for r in S.cosine_pairs(df, minimum=0.4, block=block).collect()}
        best = {(r.path, r["rank"], r.other): round(r.similarity, 9) for r in S.cosine_top_k(df, 3, block=block).collect()}
        return pairs, above, best, {tuple(r) for r in S.jaccard_pairs(inc, block=block).collect()}

    monkeypatch.setattr(S, "tiles_pay", lambda *_: False)
    want = every(7)
    monkeypatch.setattr(S, "tiles_pay", lambda *_: True)
    for block in (7, 2048):
        got = every(block)
        assert got == want
    plan = S.jaccard_pairs(inc)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan  # no row per pair and commit is shuffled


def test_tile_product_of_signs_and_frequencies():
    from couplemap.operators.tiles import tile_product, top_places
    rng = np.random.default_rng(2)
    A, B = [np.where(rng.random((50, 300)) < rng.random(300) ** 4, rng.normal(size=(50, 300)), 0.0) for _ in range(2)]
    side = lambda M: (*np.nonzero(M), M[np.nonzero(M)])
    assert np.allclose(tile_product(side(A), side(B), 50, 50), A @ B.T)
    r, c = top_places(np.zeros((2, 9)), np.ones((2, 9), bool), 3)
    assert r.tolist() == [0, 0, 0, 1, 1, 1] and c.tolist() == [0, 1, 2, 0, 1, 2]


def test_common_commits_go_by_tiles(spark):
    from couplemap.operators.tiles import tiles_pay
    rare = spark.range(4000).select((F.col("id") / 4).cast("long").alias("g"), F.col("id").alias("x"))
    assert not tiles_pay(rare, "x", "g")
    assert tiles_pay(rare.withColumn("g", F.col("g") % 5), "x", "g")


def test_nearest_pairs_leave_the_tiles(spark):
    rng = np.random.default_rng(4)
    rows = [(c, f"f{k:02d}") for c in range(40) for k in range(60) if rng.random() < 0.5]
    inc = spark.createDataFrame(rows, "commit_seq long, path string")
    every = {(r["a"], r["b"]): r["distance"] for r in S.jaccard_pairs(inc, block=16).collect()}
    few = S.jaccard_pairs(inc, block=16, nearest=2).collect()
    got = {(r["a"], r["b"]): r["distance"] for r in few}
    assert len(got) == len(few) < len(every) and all(every[p] == d for p, d in got.items())
    near = {}
    for (a, b), d in every.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append((d, y))
    for x, others in near.items():
        assert all(tuple(sorted((x, y))) in got for _, y in sorted(others)[:2])
    weights = inc.groupBy("path", F.col("commit_seq").cast("string").alias("word")).agg((F.rand(1) + 0.1).alias("w"))
    weights = cut_lineage(weights)
    cos = {(r["a"], r["b"]): r["similarity"] for r in S.cosine_pairs(weights, block=16).collect()}
    few = {(r["a"], r["b"]): r["similarity"] for r in S.cosine_pairs(weights, block=16, nearest=3).collect()}
    assert len(few) < len(cos) and all(cos[p] == s for p, s in few.items())
    for x in {p for pair in cos for p in pair}:
        best = sorted((-s, p) for p, s in cos.items() if x in p)[:3]
        assert all(p in few for _, p in best)


def test_written_tables_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: [n for folder in folders for _, _, names in os.walk(folder) for n in names if n.startswith("shuffle_")]
    before, setting = len(files()), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting)
    out = cut_lineage(spark.range(1000).repartition(7).groupBy(F.col("id") % 10).count())
    assert out.count() == 10 and spark.conf.get(setting) == kept
    assert len(files()) <= before + 2  # what the count itself wrote


def test_tiles_of_an_undealt_leaf_are_halved(spark):
    from couplemap.operators.neighbors import leaf_tiles, radius_pairs, tree_leaves
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    vectors = points.select("id", F.lit(None).cast("array<int>").alias("idx"), F.col("v").alias("val"), F.lit(None).cast("array<double>").alias("extra"))
    tiles = leaf_tiles(tree_leaves(vectors, 1.0, tile=8, worth=0.0), 8)
    assert tiles.where("i > j").count() == 0 and tiles.select("i", "j").distinct().count() <= 13 * 14 // 2
    wide = leaf_tiles(tree_leaves(vectors, 1.0, tile=2, worth=0.0), 2)
    assert wide.agg(F.max("j")).first()[0] < 13  # shards of eight, not of two
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(a, b) for a in range(100) for b in range(a + 1, 100) if d[a, b] <= 1.0}
    got = radius_pairs(points, 1.0, "id", "v", tile=8, worth=0.0).select("a", "b").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_tiles_in_little_memory():
    """Sums, nearest places and pairs of a full tile, with frequent and rare
    keys: beside the tile itself only parts of it are made."""
    import tracemalloc

    from couplemap.operators.tiles import strips, tile_product, top_places
    rng = np.random.default_rng(5)

    def side(n):
        keys = np.minimum((rng.pareto(0.5, (n, 100)) * 20).astype(np.int64), 20_000)
        rows = np.unique(np.stack([np.repeat(np.arange(n), 100), keys.ravel()], 1), axis=0)
        return rows[:, 0], rows[:, 1], rng.random(len(rows))

    n = 1536
    tile = n * n * 8
    a, b = side(n), side(n)
    tracemalloc.start()
    try:
        product = tile_product(a, b, n, n)
        r, c = top_places(product, product > 0, 5)
        assert len(r) == len(c) == 5 * n and sum(len(x) for x, _, _ in strips(product, product > 0)) == (product > 0).sum()
        assert tracemalloc.get_traced_memory()[1] < 3.2 * tile
    finally:
        tracemalloc.stop()


def test_packed_rows_are_short(spark, monkeypatch):
    """A block is packed into several short rows, which give the same pairs."""
    from couplemap.operators import tiles as T
    rng = np.random.default_rng(6)
    rows = [(f"p{i:03d}", int(k) + (1 << 40) * (i % 2), 1.0 + i % 3) for i in range(40) for k in rng.choice(50, 9, replace=False)]
    df = spark.createDataFrame(rows, "item string, key long, value double")
    items = df.select("item").distinct().select("item", F.substring("item", 2, 3).cast("long").alias("id"))

    monkeypatch.setattr(T, "PART", 25)
    packed = T._pack(items, df, 16).collect()
    assert max(len(r["items"]) for r in packed) == 4 * 25
    for block in range(3):
        parts = {r["part"]: (r["names"], r["items"], r["keys"], r["vals"]) for r in packed if r["block"] == block}
        names, (item, key, value) = T._unpack(parts)
        assert len(parts) > 2 and {(names[i], k, v) for i, k, v in zip(item, key.tolist(), value)} == {r for r in rows if int(r[0][1:]) // 16 == block}


def test_average_linkage_by_tiles(spark, monkeypatch):
    """Rounds by tiles give the clusters of the listed pairs, files of the
    same commits merge in one round, and clusters larger than a block are cut."""
    from couplemap.operators.clustering import average_linkage as A
    rng = np.random.default_rng(8)
    kinds = [set(rng.choice(30, rng.integers(2, 9), replace=False).tolist()) for _ in range(40)]
    copies = [1] * 30 + [2, 3, 5, 9, 20, 1, 1, 1, 1, 1]
    files = [(f"p{i:02d}_{k}", kind) for i, kind in enumerate(kinds) for k in range(copies[i])]
    inc = cut_lineage(spark.createDataFrame([(c, p) for p, kind in files for c in sorted(kind)], "commit_seq long, path string"))
    items = inc.select("path").distinct()
    lab = lambda **kw: {r["path"]: r["label"] for r in A.average_linkage(items, S.jaccard_pairs(inc), threshold=0.7, **kw).collect()}
    want = lab()
    assert 5 < len(set(want.values())) < 40
    monkeypatch.setattr(A, "tiles_pay", lambda *_: True)
    monkeypatch.setattr(S, "tiles_pay", lambda *_: True)
    for grouped, block in ((3, 64), (3, 16)):  # to the end; until a group does not fit a block
        assert lab(incidence=inc, grouped=grouped, block=block) == want
    ids = cut_lineage(items.select("path", F.dense_rank().over(Window.orderBy("path")).cast("long").alias("id")))
    groups = ids.select(F.col("path").alias("item"), F.col("id").alias("group"))
    merges = A._tied_merges(cut_lineage(S.nearest_groups(inc, groups, 0.0, block=16)))
    to = {r["x"]: r["y"] for r in merges.collect()}
    number = {r["path"]: r["id"] for r in ids.collect()}
    assert {to[number[f"p34_{k}"]] for k in range(20) if f"p34_{k}" != "p34_0"} == {number["p34_0"]}
    labels = spark.createDataFrame(list(want.items()), "path string, label int")
    sums = {(r["u"], r["v"]): round(r["w"], 9) for r in S.jaccard_pairs(inc, block=8, groups=labels).collect()}
    by_hand = {}
    for r in S.jaccard_pairs(inc).collect():
        u, v = sorted((want[r["a"]], want[r["b"]]))
        if u != v:
            by_hand[u, v] = by_hand.get((u, v), 0.0) + r["similarity"]
    assert sums == {k: round(w, 9) for k, w in by_hand.items()}


def test_lists_of_partners_give_the_same_merges(spark):
    """Ward by short lists against a search of every changed cluster in every
    round, with equal points, equal distances and points far off."""
    import dataclasses

    from couplemap.operators.clustering import centres
    from couplemap.operators.clustering.ward import ward_link
    rng = np.random.default_rng(12)
    X = np.vstack([rng.normal(0, 1, (60, 3)), np.repeat(rng.normal(0, 1, (2, 3)), 3, 0), [[9.0 + i % 3, 9.0 + i // 3, 9.0] for i in range(9)], [[50.0, 0, 0]]])
    points = cut_lineage(spark.createDataFrame([(int(i), None, x.tolist()) for i, x in enumerate(X)], "id long, idx array<int>, val array<double>"))
    link = ward_link(1.2)

    def clusters(link, **kw):
        features, merges = centres.agglomerate(centres.features_of(points), link, **kw)
        roots = centres.resolve_roots(points.select("id"), merges)
        weights = {r["id"]: (r["n"], [round(v, 6) for v in r["val"]]) for r in features.collect()}
        return {r["id"]: r["cid"] for r in roots.collect()}, weights

    want = clusters(dataclasses.replace(link, weight=None), tile=64)
    assert 3 < len(want[1]) < 60
    assert clusters(link, tile=32, keep=3) == want
    lists = centres._search(cut_lineage(centres.features_of(points)), link, None, 16, 3).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)).round(9)
    np.fill_diagonal(D, np.inf)
    for r in lists:
        near = sorted((d, j) for j, d in enumerate(D[r["x"]]) if d < 1.2)
        assert [(e["cost"], e["y"]) for e in r["near"]] == near[:3] and (len(near) <= 3 or r["bound"] <= near[3][0])
    assert {r["x"] for r in lists} == {i for i in range(len(X)) if D[i].min() < 1.2}


def test_tiles_of_distances_are_spread(spark):
    """Tiles of few bytes are not put into one task."""
    from couplemap.operators.neighbors import as_vectors, leaf_tiles, spread_tiles, tree_leaves
    points = spark.range(300).select(F.col("id").alias("path"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("v"))
    tiles = leaf_tiles(tree_leaves(as_vectors(points, "path", "v"), 9.0, tile=8), 8)
    per = spread_tiles(tiles, 300, 300, 8).select("node", "i", "j", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().collect()
    assert len(per) >= 16 and sum(r["count"] for r in per) > 50
