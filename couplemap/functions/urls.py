"""Repository URL functions and the links of the map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_remote(url) -> Column:
    u = _c(url)
    return u.startswith("git@") | u.startswith("https://")


def _last_index(u: Column, needle: str) -> Column:
    """1-based position of the last occurrence of ``needle`` (0 when absent)."""
    r = F.locate(needle[::-1], F.reverse(u))
    return F.when(r == 0, F.lit(0)).otherwise(F.length(u) - r - F.lit(len(needle)) + 2)


def repo_name(url, raise_error: bool = False) -> Column:
    """Text between the last '/' and the last '.git' (or the end).

    A badly formed url (no '/', or '.git' before the last '/') gives NULL,
    or fails the query when ``raise_error``."""
    u = _c(url)
    slash = _last_index(u, "/")
    suffix = _last_index(u, ".git")
    end = F.when(suffix == 0, F.length(u) + 1).otherwise(suffix)
    bad = (slash == 0) | (end <= slash)
    name = u.substr(slash + 1, end - slash - 1)
    if raise_error:
        return F.when(bad, F.raise_error(F.concat(F.lit("no repository name in url: "), u))).otherwise(name)
    return F.when(bad, F.lit(None).cast("string")).otherwise(name)


def normalize_url(url) -> Column:
    """Cut one final '.git'."""
    return F.regexp_replace(_c(url), r"\.git$", "")


def file_link(url, branch, file) -> Column:
    """url/blob/<branch>/<file>; NULL for a local repository (no branch)."""
    return F.when(_c(branch).isNotNull(),
                  F.concat(normalize_url(url), F.lit("/blob/"), _c(branch), F.lit("/"), _c(file)))


def commit_link(url, commit) -> Column:
    """url/commit/<hash>; NULL when local or when no commit ('None') is chosen."""
    u, c = _c(url), _c(commit)
    ok = u.isNotNull() & c.isNotNull() & (c != "None")
    return F.when(ok, F.concat(normalize_url(u), F.lit("/commit/"), c))
