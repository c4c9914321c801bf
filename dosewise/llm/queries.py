"""The registered queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (jaccard_join, language_id, line_quality, line_runs, periodic_runs, phrase_index, phrase_mining, pii_anchors,
               rans_output, retrieval_packing, segment_bpe, substring_dedup, toxicity)
from .sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_quality.line_quality(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "n_removed_lines", "n_removed_words", "kept")


@register
def op2_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


@register
def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.find(read_table(spark, sf_dir, "documents"))


@register
def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = phrase_index.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@register
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


@register
def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_runs.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register
def op10_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_output.write_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(read_table(spark, sf_dir, "documents"))


@register
def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)


ORACLE: dict[str, str] = {k: v for k, v in SQL.items() if k in QUERIES}
