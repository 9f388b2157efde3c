"""Readers for a change history kept as tables.

Logical schema (see FIXTURES.md):
  commits(commit_seq BIGINT, commit_id STRING, committer_ts TIMESTAMP, committer_tz STRING?)
  modifications(commit_seq BIGINT, ord BIGINT, old_path STRING?, new_path STRING?)
  files(path STRING)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class History:
    commits: DataFrame
    modifications: DataFrame
    files: DataFrame


def _read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else "parquet")
    return spark.read.format(fmt).load(path)


def scan_commits(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Ordered commit log; ``commit_seq`` is the traversal order and must be
    unique (a repeated one raises)."""
    df = _read(spark, path, fmt)
    again = df.groupBy("commit_seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"commit_seq {again[0]['commit_seq']} occurs {again[0]['n']} times")
    if "committer_tz" not in df.columns:
        df = df.withColumn("committer_tz", F.lit(None).cast("string"))
    return df.select("commit_seq", "commit_id", "committer_ts", "committer_tz")


def flatten_modifications(commits_nested: DataFrame) -> DataFrame:
    """Nested ``modified_files ARRAY<STRUCT<old_path,new_path>>`` per commit
    to one row per modification; ``ord`` is the position inside the commit."""
    return commits_nested.select(
        "commit_seq", F.posexplode("modified_files").alias("ord", "m")
    ).select(
        "commit_seq",
        F.col("ord").cast("long").alias("ord"),
        F.col("m.old_path").alias("old_path"),
        F.col("m.new_path").alias("new_path"),
    )


def scan_modifications(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    df = _read(spark, path, fmt)
    if "modified_files" in df.columns:
        return flatten_modifications(df)
    return df.select("commit_seq", F.col("ord").cast("long"), "old_path", "new_path")


def scan_files(spark: SparkSession, path: str, fmt: str | None = None, column: str = "path") -> DataFrame:
    """Live file list from a table."""
    return _read(spark, path, fmt).select(F.col(column).alias("path"))


def scan_file_tree(spark: SparkSession, root: str) -> DataFrame:
    """Live file list of a folder tree (paths only; contents are not read)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.col("path"))
    )


def _decoded(contents: DataFrame, seen: Observation | None) -> DataFrame:
    """(path, text) of (path, content BINARY): contents that are not UTF-8 are
    skipped.  ``seen`` counts n_files and n_skipped on the pass that reads."""
    text = F.col("content").cast("string")
    rows = contents.select("path", F.when(F.is_valid_utf8(text), text).alias("text"))
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("text").isNull()).alias("n_skipped"))
    return rows.where("text is not null")


def scan_sources(spark: SparkSession, path: str, fmt: str | None = None, seen: Observation | None = None) -> DataFrame:
    """sources(path, text) from a table (path, content BINARY)."""
    return _decoded(_read(spark, path, fmt).select("path", F.col("content").cast("binary").alias("content")), seen)


def scan_source_tree(spark: SparkSession, root: str, seen: Observation | None = None) -> DataFrame:
    """sources(path, text): every file under ``root`` as one text row, path
    relative to ``root``; files that cannot be decoded are skipped."""
    df = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(root)
    import os
    import re

    # the path is a URI: its escapes stand for the characters of the file name
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root_abs = os.path.abspath(root).rstrip("/") if "://" not in root else root.rstrip("/").split("://", 1)[1]
    rel = F.regexp_extract(full, re.escape(root_abs) + "/(.*)$", 1)
    return _decoded(df.select(rel.alias("path"), "content"), seen)


def _unquoted(field):
    """A name as it was: quoted names hold backslash escapes, and bytes that
    are not ASCII as three octal digits."""
    inner = F.substring(field, F.lit(2), F.length(field) - 2)
    bits = F.regexp_extract_all(inner, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))

    def plain(x):
        octal = F.unhex(F.lpad(F.conv(F.substring(x, F.lit(2), F.lit(3)), 8, 16), 2, "0"))
        code = F.substring(x, F.lit(2), F.lit(1))
        escape = F.when(code == "t", "\t").when(code == "n", "\n").when(code == "r", "\r").otherwise(code)
        return F.when(x.rlike(r"^\\[0-7]{3}$"), octal).when(F.startswith(x, F.lit("\\")), escape.cast("binary")).otherwise(x.cast("binary"))

    joined = F.aggregate(F.transform(bits, plain), F.lit(b""), lambda a, b: F.concat(a, b))
    return F.when(field.rlike('^".*"$'), F.decode(joined, "UTF-8")).otherwise(field)


def _quoted(name):
    special = name.rlike(r'["\\\t\n\r]')
    out = name
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return F.when(special, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(name)


def load_history_log(spark: SparkSession, path: str) -> History:
    """Read ``git log --name-status`` style text dumps.

    Expected record layout, one record per commit, records separated by a
    line ``@@@``::

        @@@
        <hash>\\t<committer ISO date>\\t<seq>
        M\\tpath
        A\\tpath
        D\\tpath
        R100\\told\\tnew
        C100\\tsource\\tnew

    Names with special characters are quoted with backslash escapes.

    Each record is split and exploded by Spark; no line is handled on the driver.
    """
    raw = spark.read.option("lineSep", "@@@\n").text(path)
    rec = raw.where(F.length(F.trim("value")) > 0).select(F.split(F.col("value"), "\n").alias("lines"))
    head = F.split(F.element_at("lines", 1), "\t")
    base = rec.select(
        F.element_at(head, 1).alias("commit_id"),
        F.to_timestamp(F.element_at(head, 2)).alias("committer_ts"),
        F.regexp_extract(F.element_at(head, 2), r"([+-]\d\d:?\d\d|Z)$", 1).alias("committer_tz"),
        F.element_at(head, 3).cast("long").alias("commit_seq"),
        F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"),
    )
    commits = base.select("commit_seq", "commit_id", "committer_ts",
                          F.when(F.col("committer_tz") == "", None).when(F.col("committer_tz") == "Z", "+00:00")
                          .otherwise(F.col("committer_tz")).alias("committer_tz"))
    lines = base.select("commit_seq", F.posexplode("body").alias("ord", "line")).where(F.length("line") > 0)
    parts = F.transform(F.split("line", "\t"), _unquoted)
    status = F.substring(F.element_at(parts, 1), 1, 1)
    mods = lines.select(
        "commit_seq",
        F.col("ord").cast("long").alias("ord"),
        # a copy is a birth: its source lives on
        F.when(status.isin("A", "C"), None).otherwise(F.element_at(parts, 2)).alias("old_path"),
        F.when(status == "D", None)
        .when(status.isin("R", "C"), F.element_at(parts, 3))
        .otherwise(F.element_at(parts, 2))
        .alias("new_path"),
    )
    # live files: last name of every path that was not deleted or renamed away
    from ..operators.history import live_files_from_modifications

    return History(commits, mods, live_files_from_modifications(mods))


def _local_time(ts: str, tz: str):
    """The committer's local time with its offset; without one, the session's."""
    offset = F.regexp_replace(F.col(tz), r"^([+-]\d\d):?(\d\d)$", "$1:$2")
    form = "yyyy-MM-dd HH:mm:ss"
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.col(ts), F.current_timezone()), offset)
    return F.when(offset.isNull(), F.date_format(F.col(ts), form)).otherwise(F.concat(F.date_format(local, form), offset))


def write_history_log(history: History, folder: str) -> None:
    """Write a history as the text dump ``load_history_log`` reads: every
    commit's lines go to one file in order (partitioned by commit, sorted
    inside the partition), so no commit is gathered into one row."""
    c = history.commits.select(
        "commit_seq", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("ord"),
        F.concat(F.lit("@@@\n"), F.col("commit_id"), F.lit("\t"),
                 _local_time("committer_ts", "committer_tz"), F.lit("\t"),
                 F.col("commit_seq").cast("string")).alias("value"))
    m = history.modifications.withColumns({c: _quoted(F.col(c)) for c in ("old_path", "new_path")})
    line = (
        F.when(F.col("old_path").isNull(), F.concat(F.lit("A\t"), F.col("new_path")))
        .when(F.col("new_path").isNull(), F.concat(F.lit("D\t"), F.col("old_path")))
        .when(F.col("old_path") != F.col("new_path"),
              F.concat(F.lit("R100\t"), F.col("old_path"), F.lit("\t"), F.col("new_path")))
        .otherwise(F.concat(F.lit("M\t"), F.col("new_path")))
    )
    mods = m.select("commit_seq", F.lit(1).alias("kind"), "ord", line.alias("value"))
    lines = c.unionByName(mods)
    (lines.repartition("commit_seq").sortWithinPartitions("commit_seq", "kind", "ord")
     .select("value").write.mode("overwrite").text(folder))
