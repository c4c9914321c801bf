"""Cleaning and recoding of a wide subject table.

Column-level decisions (drop empty / constant columns, numeric coercion) need
statistics of every column.  They are computed in *row form*: each row is
``posexplode``d into (column position, value) and grouped by position, so the
job is one shuffle of at most (columns x map tasks) partial aggregates no
matter how many columns there are; only the per-column summary (one row per
column) reaches the driver, where the plan is rewritten.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reshape import _q


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, cols=(), contains=(), strict: bool = True, protect=()) -> DataFrame:
    """Drop named columns plus any whose name contains one of ``contains``.

    ``strict`` raises on a named column that does not exist; ``protect`` names
    are never dropped.
    """
    missing = [c for c in cols if c not in df.columns]
    if strict and missing:
        raise KeyError(f"columns not found: {missing}")
    gone = set(cols) | {c for c in df.columns if any(s in c for s in contains)}
    return df.drop(*[c for c in df.columns if c in gone and c not in protect])


def blank_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Whitespace-only strings (``^\\s+$``) -> NULL; the empty string is left alone."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = set(cols if cols is not None else string_cols) & string_cols
    exprs = [f"CASE WHEN {_q(c)} RLIKE '^\\\\s+$' THEN NULL ELSE {_q(c)} END AS {_q(c)}" if c in targets else _q(c)
             for c in df.columns]
    return df.selectExpr(*exprs)


def column_profile(df: DataFrame, cols=None) -> DataFrame:
    """One row per column: name, non_null, min_value, max_value, numeric_fail.

    Values are compared as text; ``numeric_fail`` counts non-null cells that do
    not parse as a number.
    """
    cols = list(cols if cols is not None else df.columns)
    arr = "array(" + ", ".join(f"CAST({_q(c)} AS STRING)" for c in cols) + ")"
    names = F.array(*[F.lit(c) for c in cols])
    long = df.selectExpr(f"posexplode({arr}) AS (pos, v)")
    prof = long.groupBy("pos").agg(
        F.count("v").alias("non_null"), F.min("v").alias("min_value"), F.max("v").alias("max_value"),
        F.count(F.when(F.col("v").isNotNull() & (F.col("v")).try_cast("double").isNull(), 1)).alias("numeric_fail"),
    )
    return prof.select(F.element_at(names, F.col("pos") + 1).alias("column"), "non_null", "min_value",
                       "max_value", "numeric_fail")


def empty_and_constant_columns(df: DataFrame, protect=()):
    """Plan-time lists (all_null, single_valued) from the row-form profile."""
    rows = column_profile(df, [c for c in df.columns if c not in protect]).collect()  # one row per column
    empty = [r["column"] for r in rows if r["non_null"] == 0]
    const = [r["column"] for r in rows if r["non_null"] > 0 and r["min_value"] == r["max_value"]]
    return empty, const


def drop_empty_and_constant(df: DataFrame, protect=()) -> DataFrame:
    """Drop all-NULL columns and columns with exactly one distinct non-NULL value."""
    empty, const = empty_and_constant_columns(df, protect)
    return df.drop(*empty, *const)


def map_codes(df: DataFrame, col: str, codebook, out_col: str | None = None) -> DataFrame:
    """Numeric code -> label; unmapped or non-numeric -> NULL.

    ``codebook`` is a dict (inlined as a map literal) or a (code, label)
    DataFrame; the planner picks the join from its size.
    """
    out_col = out_col or col
    key = (F.col(col).cast("string")).try_cast("double")
    if isinstance(codebook, dict):
        m = F.create_map(*[x for k, v in codebook.items() for x in (F.lit(float(k)), F.lit(v))])
        return df.withColumn(out_col, m[key])
    code_col, label_col = codebook.columns[:2]
    cb = codebook.select(F.col(code_col).cast("double").alias("_code"), F.col(label_col).alias("_label"))
    out = df.withColumn("_code", key).join(cb, "_code", "left")
    return out.withColumn(out_col, F.col("_label")).drop("_code", "_label")


def binarize(df: DataFrame, col: str) -> DataFrame:
    """Numeric text and NULL pass unchanged; any other text becomes ``'1'``."""
    c = F.col(col).cast("string")
    return df.withColumn(col, F.when(c.isNull() | (c).try_cast("double").isNotNull(), c).otherwise(F.lit("1")))


def reverse_onehot(df: DataFrame, prefix: str, zero_is_null: bool = False) -> DataFrame:
    """Collapse one-hot columns whose name contains ``prefix`` into one label column.

    Values are coerced to numbers (junk -> NULL, NaN -> NULL); the label is the
    first column holding the row maximum with ``prefix`` removed.  An all-NULL
    row gives NULL; an all-zero row gives the first column unless
    ``zero_is_null``.  The new column is named ``prefix`` without trailing ``_``.
    """
    cols = [c for c in df.columns if prefix in c]
    if not cols:
        return df
    nums = {c: F.nanvl((F.col(c).cast("string")).try_cast("double"), F.lit(None).cast("double")) for c in cols}
    m = F.greatest(*nums.values()) if len(cols) > 1 else nums[cols[0]]
    label = F.coalesce(*[F.when(v == m, F.lit(c.replace(prefix, ""))) for c, v in nums.items()])
    if zero_is_null:
        label = F.when(m > 0, label)
    return df.withColumn(prefix.rstrip("_"), label).drop(*cols)


def numeric_or_ignore(df: DataFrame, cols) -> DataFrame:
    """Cast columns to DOUBLE only when every non-NULL cell parses (else leave the column)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    prof = column_profile(df, cols).select("column", "numeric_fail").collect()  # one row per column
    ok = [r["column"] for r in prof if r["numeric_fail"] == 0]
    return df.withColumns({c: F.col(c).cast("string").cast("double") for c in ok})


def cast_columns(df: DataFrame, numeric=(), datetimes=(), categorical=(), datetime_fmt: str = "M/d/yyyy") -> DataFrame:
    """Bulk type assignment: numeric (whole-column ignore), datetime (coerce), categorical (text)."""
    df = numeric_or_ignore(df, numeric)
    df = df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(datetime_fmt)).cast("timestamp_ntz")
                         for c in datetimes if c in df.columns})
    return df.withColumns({c: F.col(c).cast("string") for c in categorical if c in df.columns})


def select_regex(df: DataFrame, pattern: str, keep=()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if re.search(pattern, c) and c not in keep])


def select_categories(df: DataFrame, categories: dict, id_col: str) -> DataFrame:
    """id + every column listed in a {category: [columns]} dict."""
    return df.select(id_col, *[c for cs in categories.values() for c in cs])


_KINDS = {
    "number": (T.NumericType,),
    "string": (T.StringType,),
    "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def columns_of(df: DataFrame, kind: str, exclude=()) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind]) and f.name not in exclude]


def select_dtypes(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of(df, kind))


def lookup_first(df: DataFrame, keys: DataFrame, key_col: str, value_col: str, order) -> DataFrame:
    """For every key: ``value_col`` of the first row (by ``order``) whose ``key_col`` matches, else NULL.

    ``min_by`` is a partial aggregate, so a hot key costs one combiner row per task.
    """
    firsts = df.groupBy(key_col).agg(F.min_by(value_col, order).alias(value_col))
    return keys.join(firsts, key_col, "left")


def move_last(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != col], col)


def assert_no_nulls(df: DataFrame) -> DataFrame:
    """Raise if any cell is NULL (one aggregate job), else return ``df``."""
    if not df.columns:
        return df
    row = df.select(F.sum(sum((F.col(_q(c)).isNull().cast("int") for c in df.columns), F.lit(0)))).first()
    if row[0]:
        raise ValueError(f"feature set contains {row[0]} NULL cells")
    return df
