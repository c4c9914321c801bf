"""Subject-grouped, class-stratified fold assignment and seeded sampling.

Seeded choices use ``md5(seed | key)``: deterministic, engine-independent
(the same integer in Spark and plain SQL) and independent of partitioning, so
re-running a lost task reproduces the same folds and samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_sums


def seeded_hash(seed: int, *keys) -> Column:
    """First 8 hex digits of md5('seed|k1|k2...') as BIGINT in [0, 2^32)."""
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), (F.col(k) if isinstance(k, str) else k).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def class_counts(df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Per subject: rows and positives (label == 1)."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum((F.col(label_col) == 1).cast("int")).cast("bigint").alias("n_pos"))


def group_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 0,
                strata: int = 10, hash_blocks: int = 1024) -> DataFrame:
    """Assign every subject to one of ``k`` folds, balancing class mix.

    Subjects are stratified by their positive share (``strata`` bins), shuffled
    within a stratum by a seeded hash and dealt round-robin to folds, so every
    fold gets the same number (+-1) of subjects from every stratum.  The
    within-stratum rank is a two-level scan over hash blocks, so no stratum is
    ranked in a single task.  Returns id, n_rows, n_pos, stratum, fold.
    """
    cc = class_counts(df, id_col, label_col)
    cc = cc.withColumns({"stratum": F.expr(f"CAST(n_pos * {strata} DIV n_rows AS INT)"),
                         "_h": seeded_hash(seed, id_col)})
    block = F.floor(F.col("_h") * hash_blocks / F.lit(2 ** 32)).cast("int")
    # unique order inside a stratum: (hash, id) -> a single sortable key
    ranked = running_sums(cc.withColumn("_key", F.struct("_h", id_col)), ["stratum"], "_key", block, [],
                          descending=False, index_col="_rank")
    return ranked.select(id_col, "n_rows", "n_pos", "stratum",
                         ((F.col("_rank") - 1) % k).cast("int").alias("fold"))


def split_by_fold(df: DataFrame, folds: DataFrame, id_col: str, fold: int):
    """(train, test) rows for one held-out fold (join on subject)."""
    f = df.join(folds.select(id_col, "fold"), id_col, "inner")
    return f.where(F.col("fold") != fold).drop("fold"), f.where(F.col("fold") == fold).drop("fold")


def seeded_sample(df: DataFrame, n: int, seed: int, key_cols) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run (top-n by seeded hash).

    ``orderBy(...).limit(n)`` plans as a per-partition top-n and a merge of at
    most n rows per partition.
    """
    key_cols = list(key_cols)
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def first_fold_split(df: DataFrame, id_col: str, label_col: str, seed: int = 42):
    """Final-model split: two grouped folds, fold 0 held out."""
    folds = group_folds(df, id_col, label_col, k=2, seed=seed)
    return split_by_fold(df, folds, id_col, 0)
