"""Multiple correspondence analysis of the 0/1 file x commit table, 2 axes.

With the two categories (touched / not touched) of every commit, the
indicator table's standardised residuals give S S^T = X X^T / (C n) with
X[i, k] = (z[i, k] - f_k) / sqrt(f_k (1 - f_k)), f_k the share of files a
commit touches.  So the row principal coordinates are the projections of
X's rows on its two leading right singular vectors, divided by sqrt(C).

X is never made dense: X V = Z (V / s) - <f, V / s> and X^T U = Z^T U / s (the
columns of X are centred, so U's columns sum to 0), each a join of the sparse
incidence with a distributed block of ``BLOCK`` vectors.  Randomised block
subspace iteration (Halko, Martinsson, Tropp 2011): a pass multiplies the block
by X^T X and makes it orthonormal again with the eigenvectors of its Gram
matrix, which is all that the driver sees (``BLOCK`` squared numbers); the axes
are the leading Ritz vectors.  It ends when the two leading singular values
settle, after ``PASSES`` passes at the latest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage

N_COMPONENTS = 2
BLOCK = 8
PASSES = 10


def _gram(rows: DataFrame, names: list[str]) -> np.ndarray:
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, sums):
        out[i, j] = out[j, i] = value or 0.0
    return out


def _times(names: list[str], matrix: np.ndarray, out: list[str]) -> list[Column]:
    """The columns ``names`` times a small matrix."""
    def one(weights: np.ndarray) -> Column:
        total = F.lit(0.0)
        for name, w in zip(names, weights):
            total = total + F.col(name) * F.lit(float(w))
        return total

    return [one(matrix[:, k]).alias(name) for k, name in enumerate(out)]


def mca(incidence: DataFrame, tolerance: float = 1e-6, passes: int = PASSES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """incidence(path, commit_seq) -> (path, x, y)."""
    files = incidence.select("path").distinct()
    n = files.count()
    cols = incidence.groupBy("commit_seq").agg(F.count(F.lit(1)).alias("nk"))
    cols = cols.select("commit_seq", (F.col("nk") / n).alias("f")).where(F.col("f") < 1.0)
    cols = cut_lineage(cols.select("commit_seq", "f", F.sqrt(F.col("f") * (1 - F.col("f"))).alias("s")))
    c_count = cols.count()
    z = cut_lineage(incidence.select("path", "commit_seq").join(cols.select("commit_seq"), "commit_seq"))
    vs, us = [f"v{k}" for k in range(block)], [f"u{k}" for k in range(block)]

    def rows_times(v: DataFrame) -> DataFrame:
        """U = X V, one row per file."""
        w = cut_lineage(v.join(cols, "commit_seq").select("commit_seq", "f", *[(F.col(c) / F.col("s")).alias(c) for c in vs]))
        off = w.agg(*[F.sum(F.col("f") * F.col(c)) for c in vs]).first()
        u = z.join(w.drop("f"), "commit_seq").groupBy("path").agg(*[F.sum(c).alias(c) for c in vs])
        return files.join(u, "path", "left").fillna(0.0).select("path", *[(F.col(c) - F.lit(o or 0.0)).alias(d) for c, d, o in zip(vs, us, off)])

    # start vectors from a hash of the commit (deterministic on recomputation)
    start = lambda k: (F.pmod(F.xxhash64("commit_seq", F.lit(seed), F.lit(k)), F.lit(1 << 20)) + 0.5) / float(1 << 20) - 0.5
    v, before = cols.select("commit_seq", *[start(k).alias(c) for k, c in enumerate(vs)]), None
    for done in range(passes + 1):
        u = cut_lineage(rows_times(v))
        value, vector = np.linalg.eigh(_gram(u, us))
        now = np.sqrt(np.maximum(value[::-1][:N_COMPONENTS], 0.0))
        if done == passes or (before is not None and done > 1 and np.all(np.abs(now - before) <= tolerance * np.maximum(now, 1e-300))):
            break
        before = now
        t = z.join(u, "path").groupBy("commit_seq").agg(*[F.sum(c).alias(c) for c in us])
        y = cut_lineage(cols.join(t, "commit_seq", "left").fillna(0.0, us).select("commit_seq", *[(F.col(c) / F.col("s")).alias(d) for c, d in zip(us, vs)]))
        size, axes = np.linalg.eigh(_gram(y, vs))
        scale = np.where(size > 1e-12 * max(size.max(), 1e-300), 1.0 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        v = cut_lineage(y.select("commit_seq", *_times(vs, axes * scale, vs)))
    lead = vector[:, ::-1][:, :N_COMPONENTS] / np.sqrt(max(c_count, 1))
    return u.select("path", *_times(us, lead, ["x", "y"]))
