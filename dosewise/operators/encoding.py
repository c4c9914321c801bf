"""Categorical encoding with readable column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import _q


def category_levels(df: DataFrame, col: str) -> list:
    """Sorted distinct non-NULL values: one name per output column of ``one_hot``.

    For columns with very many levels use ``one_hot_vector``, which needs no column per level.
    """
    vals = df.where(F.col(_q(col)).isNotNull()).select(F.col(_q(col)).cast("string").alias("v")).distinct().collect()
    return sorted(r["v"] for r in vals)


def one_hot_vector(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Sparse indicator vector of a column with any number of levels (NULL -> all zero)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    out_col = out_col or f"{col}_vec"
    text = df.withColumn("_level", F.col(_q(col)).cast("string"))
    index = StringIndexer(inputCol="_level", outputCol="_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(text)
    # unseen and NULL values take the last index, which the encoder drops
    coded = OneHotEncoder(inputCol="_index", outputCol=out_col, dropLast=True).fit(index.transform(text)).transform(index.transform(text))
    return coded.drop("_level", "_index")


def one_hot(df: DataFrame, cols, levels: dict | None = None, keep_original: bool = False):
    """Indicator column ``{col}_{level}`` per level (NULL -> all zero).

    Returns (DataFrame, [new column names]).  Levels come from ``levels`` or,
    when absent, from the data (sorted, one distinct job per column).
    """
    levels = dict(levels or {})
    new = []
    exprs = {}
    for c in cols:
        lv = levels.get(c) or category_levels(df, c)
        for v in lv:
            name = f"{c}_{v}"
            exprs[name] = F.when(F.col(_q(c)).cast("string") == F.lit(str(v)), 1).otherwise(0)
            new.append(name)
    out = df.withColumns(exprs)
    if not keep_original:
        out = out.drop(*cols)
    return out, new


def prune_nominals(nominals, columns, id_col: str, target: str | None) -> list:
    """Nominal list restricted to present columns, excluding id and target."""
    cols = set(columns)
    return [c for c in nominals if c in cols and c != id_col and c != target]
