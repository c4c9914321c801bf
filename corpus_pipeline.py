"""A corpus pipeline of five training-data operators, each a stage over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's docs.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm import jaccard_join, language_id, line_runs, phrase_index, segment_bpe
from dosewise.llm.store import keep, small
from dosewise.session import read_table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A repeated passage of so many words goes even if it is one line or two.
PASSAGE_WORDS = 50


def beside(docs: DataFrame, *read: str) -> tuple[DataFrame, list]:
    """docs with the columns that a stage doesn't read under names of no operator, and the columns to select in the end."""
    names = {c: c if c in read else f"__kept{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; those without any letter go."""
    own, columns = beside(docs, "doc_id", "text", "lang")
    return language_id.language_id(own).where(F.col("lang_pred") != language_id.UNKNOWN).select(columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs, nor of passages of one or two lines; documents that lose all their words go."""
    own, columns = beside(docs, "doc_id", "text")
    cut = line_runs.line_dedup(own, min_words=PASSAGE_WORDS).where("n_removed = 0 or n_removed < n_lines")
    return cut.select(columns).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (5-word shingles, similarity 0.8)."""
    groups = jaccard_join.jaccard_components(docs).groupBy("doc_id").agg(F.bool_or(F.expr("n_shingles = 0 or doc_id is null or doc_id = component_id")).alias("kept"))
    # the later copies are few: the texts stay where they are, and a null id, always kept, equals none of them
    return docs.join(small(keep(groups.where("not kept").select("doc_id")), 16), "doc_id", "left_anti").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    marked = phrase_index.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    bad = small(keep(marked), 16)
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id), "left_anti")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts, and the digests of their ids and of the text decoded from them."""
    return segment_bpe.digests(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", uncontaminated),
    ("byte_bpe", token_ids),
]

#: Trained classifiers and BPE merges have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
