"""One registered query per operator: production parameters, the whole
table, digest columns derived from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts, ship_vocabulary
from .chat_format import conversation_digests, format_conversations
from .collocations import collocations
from .common import table
from .decontaminate import decontaminate
from .jaccard_join import jaccard_components
from .licenses import LOWER, UPPER, label_text, scan_licenses
from .line_dedup import dedup_lines
from .merkle import fold, leaf, merkle_manifest, proof_digest
from .oracle import SQL  # noqa: F401
from .pii import KINDS, find_pii, span_text
from .quality import judge_quality
from .token_counts import count_tokens, ship_file
from .toxicity import score_chain, train_chain
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = ship_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = encode_texts(table(spark, sf_dir, "documents"), vocabulary, decode=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_text=False)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train_chain(documents, table(spark, sf_dir, "labels"), [("quality", 0), ("toxic", 1)])
    out = score_chain(documents, model)
    return out.select(
        F.col("id").alias("doc_id"), F.round(F.col("p")[0], 6).alias("p_low_quality"), F.round(F.col("p")[1], 6).alias("p_toxic"),
        F.col("positive")[0].alias("low_quality"), F.col("positive")[1].alias("toxic"))


@register
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"), sanitise=False)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(span_text(KINDS).cast("binary"), 256).alias("base_sha256"),
        span_text([*KINDS, "term"]).alias("spans"))


@register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), ship_file(spark, public_tokenizers.path("byte_bpe_50k.json")))
    return out.withColumnRenamed("id", "doc_id")


@register
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(table(spark, sf_dir, "documents"), with_text=False)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return conversation_digests(format_conversations(rows.union(extra))).withColumnRenamed("conv", "conv_id")


@register
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = leaf(*row[:4], F.translate("text", UPPER, LOWER))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered)
    out = merkle_manifest(table(spark, sf_dir, "documents"), "doc_id", "source", leaf(*row), claim=tampered)
    folded = out.select("*", fold(F.coalesce("claim", "leaf"), F.col("steps")).alias("folded_root"))
    return folded.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@register
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    places, base = F.transform("base", lambda x: x["place"]), F.transform("base", lambda x: x["label"])
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), label_text(base).alias("base_labels"),
        label_text(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"), "score")


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
