"""History operators: renames, touches, incidence, dates, commit lists.

Everything is a long table; the dense file x commit matrix of the reference
only exists as ``incidence_long`` (distinct (path, commit) rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import with_global_index
from ..functions.paths import filter_extension
from ..session import cut_lineage
from ..sources.history import History

MAX_HOPS = 50  # fixed value of the reference: longest rename walk


def live_files(files: DataFrame, forbidden=None) -> DataFrame:
    """Live files minus the forbidden extensions, one row per path."""
    return filter_extension(files.select("path"), "path", forbidden).distinct()


def live_files_from_modifications(mods: DataFrame) -> DataFrame:
    """Paths whose last commit (in traversal order) created or changed them.
    Inside one commit deaths come before births, so two files that swap their
    names in a commit both live on."""
    born = mods.where(F.col("new_path").isNotNull()).select(
        F.col("new_path").alias("path"), "commit_seq", F.lit(True).alias("alive"))
    gone = mods.where(F.col("old_path").isNotNull() & ~F.col("old_path").eqNullSafe(F.col("new_path"))).select(
        F.col("old_path").alias("path"), "commit_seq", F.lit(False).alias("alive"))
    ev = born.unionByName(gone)
    last = ev.groupBy("path").agg(F.max_by("alive", F.struct("commit_seq", "alive")).alias("alive"))
    return last.where("alive").select("path")


def rename_map(mods: DataFrame) -> DataFrame:
    """old_path -> last new_path in traversal order (NULL = deleted).

    Rows where the path does not change are no renames.  ``max_by`` over a
    struct lets a NULL new path win (a deletion written last)."""
    return (
        mods.where(F.col("old_path").isNotNull() & ~F.col("old_path").eqNullSafe(F.col("new_path")))
        .groupBy("old_path")
        .agg(F.max_by(F.struct("new_path"), F.struct("commit_seq", "ord")).alias("w"))
        .select("old_path", F.col("w.new_path").alias("new_path"))
    )


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """(b . a)(x): apply ``a`` then ``b``.  Tables are (x, y, y_live); ``b`` is
    defined on every non-live path with an outgoing rename, live paths are
    fixpoints, every other path goes to NULL."""
    bb = b.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("y_live").alias("by_live"))
    j = a.join(bb, a.y == bb.bx, "left")
    y = (
        F.when(F.col("y").isNull(), F.lit(None))
        .when(F.col("y_live"), F.col("y"))
        .when(F.col("bx").isNotNull(), F.col("by"))
    )
    y_live = F.when(F.col("y_live"), True).when(F.col("bx").isNotNull(), F.col("by_live")).otherwise(False)
    return j.select("x", y.alias("y"), F.coalesce(y_live, F.lit(False)).alias("y_live"))


def _unfinished(g: DataFrame) -> int:
    return g.where(F.col("y").isNotNull() & ~F.col("y_live")).limit(1).count()


def resolver(renames: DataFrame, live: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Table (path, current_path) for every live path and every renamed path.

    current = f^max_hops(path) with f(live) = live, f(x) = rename(x), else NULL,
    which is the reference's bounded walk (a cycle or a too long chain ends
    on whatever path it stands).  Computed by pointer doubling: f, f^2, f^4 ...
    (one equi-join each, materialised in the checkpoint folder), stopping as
    soon as every walk has reached a live path or NULL.
    """
    lv = live.select(F.col("path").alias("lp")).distinct()
    edges = renames.join(lv, renames.old_path == lv.lp, "left_anti")
    g = (
        edges.join(lv, edges.new_path == lv.lp, "left")
        .select(F.col("old_path").alias("x"), F.col("new_path").alias("y"),
                F.col("lp").isNotNull().alias("y_live"))
    )
    g = cut_lineage(g)
    powers = {1: g}
    k = 1
    result = None
    while True:
        if _unfinished(powers[k]) == 0:
            result = powers[k]
            break
        if 2 * k > max_hops:
            break
        powers[2 * k] = cut_lineage(_compose(powers[k], powers[k]))
        k *= 2
    if result is None:
        # f^max_hops from the binary expansion of max_hops
        acc = None
        rem = max_hops
        for p in sorted(powers, reverse=True):
            if p <= rem:
                acc = powers[p] if acc is None else _compose(acc, powers[p])
                rem -= p
        result = acc
    walked = result.select(F.col("x").alias("path"), F.col("y").alias("current_path"))
    fixed = lv.select(F.col("lp").alias("path"), F.col("lp").alias("current_path"))
    return fixed.unionByName(walked)


def resolve_renames(history: History, live: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Every distinct new path of the log with its current path (NULL when it
    no longer exists)."""
    starts = history.modifications.where(F.col("new_path").isNotNull()).select(
        F.col("new_path").alias("path")).distinct()
    res = resolver(rename_map(history.modifications), live, max_hops)
    return starts.join(res, "path", "left")


def commit_sizes(mods: DataFrame) -> DataFrame:
    """Number of modified files per commit, resolved or not (the bulk filter's count)."""
    return mods.groupBy("commit_seq").agg(F.count(F.lit(1)).alias("n_mods"))


def current_touches(history: History, live: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Modifications whose new path resolves to a current path.

    Output (commit_seq, ord, path, n_mods, commit_id, committer_ts,
    committer_tz); repeats inside one commit are kept (the commit lists need them)."""
    mods = history.modifications
    res = resolver(rename_map(mods), live, max_hops).where(F.col("current_path").isNotNull())
    t = mods.join(res, mods.new_path == res.path).select("commit_seq", "ord", F.col("current_path").alias("path"))
    commits = history.commits.select("commit_seq", "commit_id", "committer_ts", "committer_tz")
    return t.join(commit_sizes(mods), "commit_seq").join(commits, "commit_seq")


def filter_bulk_commits(touches: DataFrame, remove_bulk: int = -1) -> DataFrame:
    """Keep touches of commits with fewer than ``remove_bulk`` modified files
    (-1 keeps all).  Only the incidence uses it; dates and commit lists do not."""
    if remove_bulk is None or remove_bulk == -1:
        return touches
    return touches.where(F.col("n_mods") < F.lit(remove_bulk))


def incidence_long(touches: DataFrame) -> DataFrame:
    """The 0/1 file x commit matrix as its non-zero cells."""
    return touches.select("path", "commit_seq").distinct()


def file_heights(incidence: DataFrame) -> DataFrame:
    """Commits per file (the row sums of the matrix)."""
    return incidence.groupBy("path").agg(F.count(F.lit(1)).alias("height"))


def commit_to_files(touches: DataFrame) -> DataFrame:
    """Ordered files of each commit as a long table (commit_id, ord, path):
    the order inside a commit is ``ord``; no commit is gathered into one row."""
    return touches.select("commit_seq", "commit_id", "ord", "path")


def commit_files_outer(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """Like ``commit_to_files`` but every commit appears; an empty commit has
    one row with NULL ord and path."""
    t = touches.select("commit_seq", "ord", "path")
    return commits.select("commit_seq", "commit_id").join(t, "commit_seq", "left")


def commit_files_arrays(touches: DataFrame, commits: DataFrame) -> DataFrame:
    """Array form (commit_id, files) for export of small histories."""
    lists = touches.groupBy("commit_seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]).alias("files"))
    return commits.select("commit_seq", "commit_id").join(lists, "commit_seq", "left").select(
        "commit_seq", "commit_id", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def file_dates(touches: DataFrame) -> DataFrame:
    """First and last commit date of each file, in traversal order (not min/max
    of dates), with the committer's UTC offset of each when the log has it."""
    key = F.struct("commit_seq", "ord")
    aggs = [
        F.min_by("committer_ts", key).alias("creation_date"),
        F.max_by("committer_ts", key).alias("last_modification"),
    ]
    if "committer_tz" in touches.columns:
        aggs += [F.min_by("committer_tz", key).alias("creation_tz"),
                 F.max_by("committer_tz", key).alias("last_modification_tz")]
    return touches.groupBy("path").agg(*aggs)


def history_counts(live: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: number of live files, number of commits."""
    nf = live.select(F.count(F.lit(1)).alias("number_files"))
    nc = commits.select(F.count(F.lit(1)).alias("total_commits"))
    return nf.select("number_files", nc.select("total_commits").scalar().alias("total_commits"))


def commit_rank(commits: DataFrame) -> DataFrame:
    """Position of each commit in the traversal (0-based)."""
    return with_global_index(commits.select("commit_seq", "commit_id"), [F.col("commit_seq")], name="rank")


def hashes_newest_first(commits: DataFrame) -> DataFrame:
    """(pos, commit_id): 'None' at 0, then the newest commit first."""
    idx = with_global_index(commits.select("commit_seq", "commit_id"), [F.col("commit_seq").desc()],
                            name="pos", start=1)
    none = commits.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("None").alias("commit_id"))
    return idx.select("pos", "commit_id").unionByName(none)
