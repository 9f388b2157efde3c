"""Pairwise coupling: Jaccard over commit sets, cosine over tf-idf rows.

The n x n matrices of the reference are kept sparse: one row per pair
(a < b) with a non-zero similarity; every absent pair has similarity 0
(distance 1) and the diagonal is similarity 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cooccurrence import DEFAULT_TILE, pair_rows
from .tiles import BLOCK, strips, tile_pairs, tiles_pay, top_places


def coupled_pairs(incidence: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """(a, b, n_common): file pairs sharing n_common commits."""
    p = pair_rows(incidence.select("commit_seq", "path"), "commit_seq", "path", tile=tile)
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_common"))


def _best_places(nearness: np.ndarray, shared: np.ndarray, k: int) -> np.ndarray:
    """Of the shared places each row's and each column's k nearest; of equally
    near ones the first."""
    out = np.zeros_like(shared)
    out[top_places(nearness, shared, k)] = True
    out.T[top_places(nearness.T, shared.T, k)] = True
    return out


def _jaccard_nearness(product: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Minus the distances of a tile, made in one array."""
    out = np.add.outer(ha, hb).astype(float)
    out -= product
    np.divide(product, out, out=out)
    np.subtract(1.0, out, out=out)
    return np.negative(out, out=out)


def _tiled_common(incidence: DataFrame, block: int, nearest: int | None) -> DataFrame:
    """(a, b, height_a, height_b, n_common) by tiles."""
    def finish(product, shared, a, b) -> Iterator[pa.RecordBatch]:
        if nearest is not None:
            shared = _best_places(_jaccard_nearness(product, a[1], b[1]), shared, nearest)
        for r, c, n in strips(product, shared):
            yield pa.RecordBatch.from_arrays(
                [a[0].take(pa.array(r)), b[0].take(pa.array(c)), pa.array(a[1][r], pa.int64()), pa.array(b[1][c], pa.int64()), pa.array(np.rint(n).astype(np.int64))],
                names=["a", "b", "height_a", "height_b", "n_common"])

    return tile_pairs(incidence, "path", "commit_seq", None, finish, "a string, b string, height_a long, height_b long, n_common long", block)


def _group_sums(product: np.ndarray, a: tuple, b: tuple) -> tuple:
    """(sums of the similarities between the groups of a tile, groups of the
    rows, their sizes, groups of the columns, their sizes)."""
    sums = np.add.outer(a[1], b[1]).astype(float)
    sums -= product
    np.divide(product, sums, out=sums)
    sides = []
    for axis, names in ((0, a[0]), (1, b[0])):
        labels, starts, sizes = np.unique(np.array(names.to_pylist(), np.int64), return_index=True, return_counts=True)
        if len(labels) < len(names):
            sums = np.add.reduceat(sums, starts, axis=axis)
        sides += [labels, sizes]
    return sums, *sides


def _grouped_similarity(incidence: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(u, v, w) with u < v: sums of the similarities of files of two groups."""
    def finish(product, shared, a, b) -> Iterator[pa.RecordBatch]:
        sums, ga, _, gb, _ = _group_sums(product, a, b)
        for r, c, w in strips(sums, (sums > 0) & (ga[:, None] < gb[None, :])):  # blocks are in the order of groups
            yield pa.RecordBatch.from_arrays([pa.array(ga[r]), pa.array(gb[c]), pa.array(w)], names=["u", "v", "w"])

    parts = tile_pairs(incidence, "path", "commit_seq", None, finish, "u long, v long, w double", block, groups, whole=False)
    return parts.groupBy("u", "v").agg(F.sum("w").alias("w"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def nearest_groups(incidence: DataFrame, groups: DataFrame, above: float, digits: int = 12, block: int = BLOCK) -> DataFrame:
    """(x, s, n, least, mark, own): of every group (item, group) its highest
    mean similarity ``s`` to another one, rounded, if it is above ``above``; how
    many groups reach it, the first of them, and their mixed numbers' xor
    beside the group's own.  Pairs of files stay in their tiles, which hand on
    a row per group."""
    def best(mean: np.ndarray, mine: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
        top = mean.max(axis=1)
        r, c = np.nonzero((mean == top[:, None]) & (top > above)[:, None])
        rows, starts, n = np.unique(r, return_index=True, return_counts=True)
        mark = np.bitwise_xor.reduceat(_mixed(others)[c], starts) if len(r) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (mine[rows], top[rows], n.astype(np.int64), others[c[starts]], mark, _mixed(mine)[rows])], names=["x", "s", "n", "least", "mark", "own"])

    def finish(product, shared, a, b) -> Iterator[pa.RecordBatch]:
        mean, ga, na, gb, nb = _group_sums(product, a, b)
        mean /= np.multiply.outer(na, nb)
        np.round(mean, digits, out=mean)
        if ga[0] == gb[0]:
            np.fill_diagonal(mean, -np.inf)
            yield best(mean, ga, gb)
        else:
            yield best(mean, ga, gb)
            yield best(mean.T, gb, ga)

    tiles = tile_pairs(incidence, "path", "commit_seq", None, finish, "x long, s double, n long, least long, mark long, own long", block, groups)
    ties = tiles.groupBy("x", "s").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.bit_xor("mark").alias("mark"), F.max("own").alias("own"))
    return ties.groupBy("x").agg(F.max(F.struct("s", "n", "least", "mark", "own")).alias("b")).select("x", "b.*")


def groups_fit(groups: DataFrame, block: int = BLOCK) -> bool:
    """Whether no group (path, label) has more files than a block."""
    largest = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return largest is None or largest <= block


def jaccard_pairs(incidence: DataFrame, tile: int = DEFAULT_TILE, block: int = BLOCK, nearest: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, n_common, height_a, height_b, similarity, distance).

    With ``groups`` (path, label): (u, v, w), the sums of the similarities
    between the files of two groups u < v.

    With ``nearest`` only pairs that may be among the ``nearest`` nearest ones of
    a file need come out (of equally near files, the first by name): a tile
    then hands on the nearest ones of its files instead of all its pairs.

    Where commits hold many files the pairs are made by tiles, otherwise by a
    join on the commit.  Heights ride along, so the pair table is never joined
    back to the per-file table."""
    sim = F.col("n_common") / (F.col("height_a") + F.col("height_b") - F.col("n_common"))
    known = incidence.select("commit_seq", "path").where("commit_seq is not null and path is not null")
    if groups is not None:
        if tiles_pay(known, "path", "commit_seq", block):
            return _grouped_similarity(known, groups.select(F.col("path").alias("item"), F.col("label").cast("long").alias("group")), block)
        ga, gb = (groups.select(F.col("path").alias(x), F.col("label").cast("long").alias(f"g{x}")) for x in "ab")
        between = jaccard_pairs(incidence, tile, block).join(ga, "a").join(gb, "b").where("ga <> gb")
        return between.groupBy(F.least("ga", "gb").alias("u"), F.greatest("ga", "gb").alias("v")).agg(F.sum("similarity").alias("w"))
    if tiles_pay(known, "path", "commit_seq", block):
        return _tiled_common(known, block, nearest).select("a", "b", "n_common", "height_a", "height_b", sim.alias("similarity"), (F.lit(1.0) - sim).alias("distance"))
    h = incidence.groupBy("path").agg(F.count(F.lit(1)).alias("height"))
    x = incidence.select("commit_seq", "path").join(h, "path")
    p = pair_rows(x, "commit_seq", "path", carry=["height"], tile=tile)
    agg = p.groupBy("a", "b", "height_a", "height_b").agg(F.count(F.lit(1)).alias("n_common"))
    return agg.select("a", "b", "n_common", "height_a", "height_b",
                      sim.alias("similarity"), (F.lit(1.0) - sim).alias("distance"))


def invert_similarity(df: DataFrame, col: str = "similarity", out: str = "distance") -> DataFrame:
    return df.withColumn(out, F.lit(1.0) - F.col(col))


# ---- text: tf, idf, tf-idf, cosine -------------------------------------------------

def _with_tf(counts: DataFrame) -> DataFrame:
    """Adds tf = count / tokens of the file.  A window by path stays where
    the counts were made, if those are dealt by path."""
    n_tokens = F.sum("cnt").over(Window.partitionBy("path"))
    return counts.withColumn("tf", F.col("cnt") / n_tokens)


def term_frequency(counts: DataFrame) -> DataFrame:
    """(path, word, tf) with tf = count / tokens of the file, from
    (path, word, cnt); rows without a path belong to no file."""
    return _with_tf(counts.where("path is not null")).select("path", "word", "tf")


def inverse_doc_frequency(counts: DataFrame, parsed: DataFrame) -> DataFrame:
    """(word, df, idf) with idf = ln(N / df); N counts every parsed file, empty
    ones included; no smoothing (a word in every file weighs 0)."""
    n_docs = parsed.select(F.count(F.lit(1))).scalar()
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.select("word", "df", F.ln(n_docs / F.col("df")).alias("idf"))


def tf_idf(counts: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path, word, tf, idf, w) from (path, word, cnt).  Counts and tf are
    written once, so the text is tokenised once."""
    rows = cut_lineage(_with_tf(counts).select("path", "word", "tf"))
    idf = inverse_doc_frequency(rows, parsed)
    tf = rows.where("path is not null")
    return tf.join(idf, "word").select("path", "word", "tf", "idf", (F.col("tf") * F.col("idf")).alias("w"))


def _unit_rows(weights: DataFrame) -> DataFrame:
    """(path, word, u): rows of norm 1; zero weights (idf = 0) are dropped, so
    a row of norm 0 has similarity 0 to all."""
    nz = weights.where(F.col("w") != 0)
    norms = nz.groupBy("path").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return nz.join(norms, "path").select("path", "word", (F.col("w") / F.col("norm")).alias("u"))


def _tiled_cosine(u: DataFrame, minimum: float | None, block: int, nearest: int | None = None) -> DataFrame:
    """(a, b, similarity) by tiles; what is below ``minimum`` stays in its task."""
    def finish(product, shared, a, b) -> Iterator[pa.RecordBatch]:
        if minimum is not None:
            shared = shared & (product >= minimum)
        if nearest is not None:
            shared = _best_places(product - 1.0, shared, nearest)
        for r, c, s in strips(product, shared):
            yield pa.RecordBatch.from_arrays([a[0].take(pa.array(r)), b[0].take(pa.array(c)), pa.array(s)], names=["a", "b", "similarity"])

    return tile_pairs(u, "path", "word", "u", finish, "a string, b string, similarity double", block)


def cosine_pairs(weights: DataFrame, tile: int = DEFAULT_TILE, minimum: float | None = None, block: int = BLOCK, nearest: int | None = None) -> DataFrame:
    """(a, b, similarity) from sparse rows (path, word, w): every pair that
    shares a word, or with ``minimum`` the pairs that reach it; ``nearest`` as
    in ``jaccard_pairs``."""
    u = cut_lineage(_unit_rows(weights).where("path is not null and word is not null"))
    if minimum is not None:
        prefixes = cut_lineage(weighted_prefixes(u, minimum))
        if not tiles_pay(prefixes, "path", "word", block):
            return _cosine_above(u, prefixes, minimum, tile)
        return _tiled_cosine(u, minimum, block)
    if tiles_pay(u, "path", "word", block):
        return _tiled_cosine(u, None, block, nearest)
    p = pair_rows(u, "word", "path", carry=["u"], tile=tile)
    return p.groupBy("a", "b").agg(F.sum(F.col("u_a") * F.col("u_b")).alias("similarity"))


def weighted_prefixes(u: DataFrame, minimum: float) -> DataFrame:
    """(path, word, u, rest): each row's words, rarest first, as long as the
    norm ``rest`` from the word on reaches ``minimum``.

    Two rows whose prefixes share no word are below the minimum: let x's prefix
    end first in the order.  Then all shared words stand behind x's prefix, and
    by Cauchy-Schwarz their products sum to at most the norm of x's remainder."""
    df = u.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    onward = Window.partitionBy("path").orderBy("df", "word").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = u.join(df.where("df > 1"), "word", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rows = rows.withColumn("rest", F.sqrt(F.sum(F.col("u") * F.col("u")).over(onward)))
    # a word of one row meets nobody; it only stands before the others in the order
    return rows.where((F.col("rest") >= minimum - 1e-9) & (F.col("df") > 1)).select("path", "word", "u", "rest")


def _cosine_above(u: DataFrame, prefixes: DataFrame, minimum: float, tile: int) -> DataFrame:
    met = pair_rows(prefixes, "word", "path", carry=["u", "rest"], tile=tile)
    # of the shared prefix words, the last one in the order has the smallest
    # remainders; what is shared behind it is at most their product
    seen = met.groupBy("a", "b").agg(
        F.sum(F.col("u_a") * F.col("u_b")).alias("sum"), F.min("rest_a").alias("ra"), F.min("rest_b").alias("rb"))
    pairs = cut_lineage(seen.where(F.col("sum") + F.col("ra") * F.col("rb") >= minimum - 1e-9).select("a", "b"))
    left = u.select(F.col("path").alias("a"), "word", F.col("u").alias("ua"))
    right = u.select(F.col("path").alias("b"), "word", F.col("u").alias("ub"))
    dots = pairs.join(left, "a").join(right, ["b", "word"]).groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("similarity"))
    return dots.where(F.col("similarity") >= minimum)


def _tiled_top_k(u: DataFrame, k: int, block: int) -> DataFrame:
    """(path, other, similarity): of every tile the k best columns of each
    row and the k best rows of each column."""
    def finish(product, shared, a, b) -> Iterator[pa.RecordBatch]:
        near = np.multiply(product, 1e9, out=product)
        near += 0.5
        np.floor(near, out=near)
        near /= 1e9
        for s, keep, x, y in ((near, shared, a, b), (near.T, shared.T, b, a)):
            r, c = top_places(s, keep, k)
            yield pa.RecordBatch.from_arrays([x[0].take(pa.array(r)), y[0].take(pa.array(c)), pa.array(s[r, c])], names=["path", "other", "similarity"])

    return tile_pairs(u, "path", "word", "u", finish, "path string, other string, similarity double", block)


def cosine_top_k(weights: DataFrame, k: int, start: float = 0.5, tile: int = DEFAULT_TILE, block: int = BLOCK) -> DataFrame:
    """(path, rank, other, similarity): the k nearest rows of every row that
    shares a word with others (by similarity to nine digits, then name).

    Where words are common, every tile of the product gives its k best and
    the best of these stay.  Otherwise rows that have k partners of similarity
    ``start`` or more are done after the filtered join; pairs of the others come
    from the full one."""
    def both(pairs: DataFrame) -> DataFrame:
        near = F.round("similarity", 9).alias("similarity")
        return pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), near).unionByName(
            pairs.select(F.col("b").alias("path"), F.col("a").alias("other"), near))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("path").orderBy(F.desc("similarity"), "other")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    weights = cut_lineage(weights)
    u = cut_lineage(_unit_rows(weights).where("path is not null and word is not null"))
    if tiles_pay(u, "path", "word", block):
        out = best(_tiled_top_k(u, k, block))
        return out.select("path", F.col("rank").cast("long").alias("rank"), "other", "similarity")
    near = cut_lineage(best(both(cosine_pairs(weights, tile, minimum=start))))
    done = cut_lineage(near.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("path"))
    out = near.join(done, "path", "left_semi")
    rest = weights.select("path").distinct().join(done, "path", "left_anti")
    if rest.limit(1).count():
        rest = cut_lineage(rest)
        out = out.unionByName(best(both(cosine_pairs(weights, tile)).join(rest, "path", "left_semi")))
    return out.select("path", F.col("rank").cast("long").alias("rank"), "other", "similarity")


def cosine_vectors(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors (arrays); NULL when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))
    nb = F.sqrt(F.aggregate(F.transform(b, lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))
    return F.try_divide(dot, na * nb)
