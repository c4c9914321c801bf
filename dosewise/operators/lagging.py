"""Per-subject lag features and feature-set preparation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import assert_no_nulls, columns_of, move_last
from .collinearity import correlated_to_drop
from .encoding import one_hot, prune_nominals
from .reshape import _q


@dataclass(frozen=True)
class FeatureSet:
    """A feature table plus the metadata the modelling steps need."""

    df: DataFrame
    name: str
    id_col: str
    target_col: str | None = None
    horizon: str | None = None
    n_lags: int | None = None
    nominal_cols: tuple = field(default_factory=tuple)
    categorical_cols: tuple = field(default_factory=tuple)

    def with_df(self, df: DataFrame, **kw) -> "FeatureSet":
        return replace(self, df=df, **kw)


def lag_features(df: DataFrame, id_col: str, time_col: str, target_col: str, n_in: int = 1, n_out: int = 1,
                 dropnan: bool = True):
    """Frame each subject's series as supervised rows.

    Every non-id column ``c`` is shifted by row (not calendar) within the
    subject ordered by ``time_col``: ``c (t-i)`` for i = n_in..1, ``c (t)``
    and ``c (t+i)``.  With ``dropnan`` a row with any NULL shifted value is
    dropped (first n_in rows and last n_out-1 rows of each subject).  Then
    columns naming the time column are removed, only ``(t-`` columns and target
    columns stay, and ``target (t)`` becomes ``target``.

    Returns (DataFrame, {base column: [lagged names]}).  Windows are per
    subject over an aggregated horizon table, so partitions are bounded by the
    number of periods per subject.
    """
    base = [c for c in df.columns if c != id_col]
    w = Window.partitionBy(id_col).orderBy(time_col)
    shifted = {}
    for i in range(n_in, 0, -1):
        for c in base:
            shifted[f"{c} (t-{i})"] = F.lag(F.col(_q(c)), i).over(w)
    for i in range(n_out):
        for c in base:
            shifted[f"{c} (t)" if i == 0 else f"{c} (t+{i})"] = \
                F.col(_q(c)) if i == 0 else F.lead(F.col(_q(c)), i).over(w)
    out = df.select(F.col(id_col), *[e.alias(n) for n, e in shifted.items()])
    if dropnan:
        out = out.dropna(subset=list(shifted))
    keep = [n for n in shifted if time_col not in n and ("(t-" in n or target_col in n)]
    out = out.select(id_col, *[F.col(_q(n)).alias(target_col if n == f"{target_col} (t)" else n) for n in keep])
    mapping = {c: [n for n in keep if n.startswith(c + " (")] for c in base}
    return out, mapping


def one_hot_featureset(fs: FeatureSet, levels: dict | None = None) -> FeatureSet:
    """One-hot the categorical columns, keep numeric columns only, prune nominals."""
    df, new = one_hot(fs.df, list(fs.categorical_cols), levels)
    num = columns_of(df, "number")
    df = df.select(*num)
    noms = prune_nominals(list(fs.nominal_cols) + new, df.columns, fs.id_col, fs.target_col)
    return fs.with_df(df, nominal_cols=tuple(noms), categorical_cols=())


def prepare(fs: FeatureSet, n_lags: int | None = None, levels: dict | None = None,
            reduce_collinearity: bool = False, check_nulls: bool = True) -> FeatureSet:
    """One-hot -> (drop correlated) -> lag -> target last -> NULL check."""
    fs = one_hot_featureset(fs, levels)
    if reduce_collinearity:
        skip = {fs.id_col, fs.target_col, "study_day", "study_week", "study_month"}
        cols = [c for c in fs.df.columns if c not in skip]
        fs = fs.with_df(fs.df.drop(*correlated_to_drop(fs.df, cols)))
    if n_lags:
        df, mapping = lag_features(fs.df, fs.id_col, fs.horizon, fs.target_col, n_in=n_lags)
        # nominal base columns map to their lagged names exactly (no substring guessing)
        noms = [n for b in fs.nominal_cols for n in mapping.get(b, [])]
        fs = fs.with_df(df, n_lags=n_lags, nominal_cols=tuple(prune_nominals(noms, df.columns, fs.id_col,
                                                                             fs.target_col)))
    if fs.target_col:
        fs = fs.with_df(move_last(fs.df, fs.target_col))
    if check_nulls:
        assert_no_nulls(fs.df)
    return fs
