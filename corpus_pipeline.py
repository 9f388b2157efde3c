"""From raw documents to token ids, in five stages.

quality rules -> line dedup -> n-gram Jaccard join -> benchmark
decontamination -> byte-level BPE.  Each stage works on all that the one
before kept; between stages the documents are a Parquet table in the shared
folder.  All stages but the last return the columns of ``documents`` (``text``
changed, ``n_chars`` following it).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from couplemap.llm.bpe import encode_texts, ship_vocabulary
from couplemap.llm.common import table
from couplemap.llm.decontaminate import decontaminate
from couplemap.llm.jaccard_join import jaccard_components
from couplemap.llm.line_dedup import dedup_lines
from couplemap.llm.quality import judge_quality
from couplemap.session import cut_lineage, ship_package

MIN_WORDS = 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MADE = ("text", "n_chars")  # what a stage makes anew; the other columns are handed through


def _stage(work: Stage) -> Stage:
    """A stage may be called on its own: its Python workers need the package."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return work(spark, docs, sf_dir)

    return run_stage


def _documents(out: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The carried columns with another text."""
    def one(name: str) -> Column:
        if name == "text":
            return F.col(text).alias(name)
        if name == "n_chars":
            return F.length(text).cast("long").alias(name)
        return F.col("carried").getField(name).alias(name)

    return out.select(*[one(c) for c in columns])


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in MADE]


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    out = judge_quality(docs, min_words=MIN_WORDS, carry=_others(docs))
    return _documents(out.where("kept"), docs.columns, "clean")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that a document with a smaller id holds.  A document that is
    left with less than half of its characters and under ``MIN_WORDS`` words
    was a copy, and goes."""
    out = dedup_lines(docs, carry=_others(docs))
    words = F.size(F.filter(F.split("kept", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    left = (F.col("n_dropped") == 0) | (2 * F.length("kept") >= F.col("n_chars")) | (words >= MIN_WORDS)
    return _documents(out.where(left), docs.columns, "kept")


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the
    smallest id (rows without an id come last, equal ids are told apart by their
    texts).  Rows are dropped by id and text together, so a row is lost only if
    one of its own group stays.  Rows of one id and text stay once; rows without
    words have no group and stay as they are."""
    rows = cut_lineage(jaccard_components(docs, with_rows=True).where("group is not null").select("id", "row", "group"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")).select("group", "first.id", "first.row")
    gone = rows.distinct().join(
        first.select(F.col("group").alias("g"), F.col("id").alias("i"), F.col("row").alias("r")),
        (F.col("group") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left_anti").select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"))
    again = rows.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again_id"), F.col("row").alias("again_row"))
    text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    among = lambda name: docs["doc_id"].eqNullSafe(F.col(f"{name}_id")) & (text == F.col(f"{name}_row"))
    kept = docs.join(gone, among("gone"), "left_anti")
    once = kept.join(again, among("again"), "left_anti")
    twice = kept.join(again, among("again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(twice)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that consist of
    them for more than half go."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=_others(docs))
    return _documents(out.where("clean is not null"), docs.columns, "clean")


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)"""
    vocabulary = ship_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = encode_texts(docs, vocabulary, decode=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no byte-pair encoding; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
