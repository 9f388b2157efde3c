"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference: extensions left out of the analysis.
FORBIDDEN_EXTENSIONS = [".zip", ".gif", ".png"]

# Extension as ``os.path.splitext`` sees it: the last '.xxx' of the base name,
# leading dots of the base name do not start an extension.
_EXT_RE = r"[^/.][^/]*(\.[^./]*)$"


def extension(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, _EXT_RE, 1)


def keep_extension(path: Column | str, forbidden=None) -> Column:
    """True when the path's extension is not in the forbidden list (case-sensitive)."""
    forbidden = FORBIDDEN_EXTENSIONS if forbidden is None else list(forbidden)
    return ~extension(path).isin(forbidden)


def filter_extension(files: DataFrame, path: str = "path", forbidden=None) -> DataFrame:
    return files.where(keep_extension(path, forbidden))


def normalize_path(path: Column | str) -> Column:
    """Backslashes to forward slashes."""
    return F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")


def common_prefix_length(parts_a: Column, parts_b: Column) -> Column:
    """Number of leading equal elements of two arrays."""
    n = F.least(F.size(parts_a), F.size(parts_b))
    idx = F.sequence(F.lit(1), n)
    # first position where they differ; n + 1 when one is a prefix of the other
    first_diff = F.aggregate(
        idx,
        F.lit(0),
        lambda acc, i: F.when(
            (acc == 0) & (F.element_at(parts_a, i) != F.element_at(parts_b, i)), i
        ).otherwise(acc),
    )
    return F.when(n <= 0, F.lit(0)).when(first_diff == 0, n).otherwise(first_diff - 1)


def strip_common_prefix(files: DataFrame, path: str = "path", out: str = "path") -> DataFrame:
    """Drop the longest common folder of all paths, like ``os.path.commonpath``.

    The component-wise minimum and maximum of the split paths share exactly
    the prefix common to all rows, so two scalar aggregates (partial, then
    final; one row each) are enough: no cross join and no sort.
    A single path is its own common path, so it strips to ''.
    """
    parts = F.split(F.col(path), "/")
    bounds = files.select(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    k = common_prefix_length(lo, hi)
    prefix = F.array_join(F.slice(lo, 1, F.greatest(k, F.lit(1))), "/")
    # a common path of only the root '/' is one character long
    plen = F.when(k == 0, F.lit(0)).when(prefix == "", F.lit(1)).otherwise(F.length(prefix))
    # one row, one value: a scalar sub-query inlined into the projection
    plen_value = bounds.select(plen.alias("plen")).scalar()
    # like the reference, always cut the prefix and one separator
    stripped = F.substring(F.col(path), plen_value + 2, 1 << 30)
    return files.withColumn(out, F.coalesce(stripped, F.lit("")))
