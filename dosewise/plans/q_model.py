"""Scaling/imputation queries (SQL-checked) and model queries (rows-only).

Model queries train on the lagged daily feature set (3 lags) with the
subject-grouped 50/50 final split (seed 42), as the analysis does for its
final classifiers, and return metric rows for the train and test sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import assert_no_nulls
from ..operators.evaluation import classification_metrics
from ..operators.folds import first_fold_split
from ..operators.lagging import one_hot_featureset
from ..operators.modeling import GRIDS, repeated_cv, select_by_forest, train_test, tune, tune_lags
from ..operators.oversample import smote
from ..operators.results import lag_tuning_curve
from ..operators.scaling import chained_impute, minmax, mode_fill
from ..session import cut_lineage
from . import oracle as O
from .cohort import clocked_events
from .featuresets import category_levels_for, featureset, lagged_featureset
from .q_tables import _WF_SQL
from .registry import SPEC, events, r6, register

_SCALE_COLS = ["n_events", "event_time_mean", "event_time_std", "between_event_time_std", "adherence_rate"]


def _weekly(spark, sf_dir):
    from ..operators.horizons import period_features
    from .cohort import analysis_events
    return period_features(analysis_events(events(spark, sf_dir), SPEC), "study_week")


@register("minmax_scale", O.with_cohort("SELECT user_id, study_week, " + ", ".join(
    f"ROUND((CAST({c} AS DOUBLE) - MIN({c}) OVER ()) / COALESCE(NULLIF(MAX({c}) OVER () - MIN({c}) OVER (), 0), 1), 6)"
    f" + 0.0 AS {c}" for c in _SCALE_COLS) + " FROM wf", _WF_SQL))
def q_minmax(spark, sf_dir):
    wk = _weekly(spark, sf_dir).select("user_id", "study_week", *_SCALE_COLS)
    out = minmax(wk, wk, _SCALE_COLS)
    return out.withColumns({c: r6(c) for c in _SCALE_COLS})


@register("mode_impute", O.with_cohort(f"""
SELECT user_id, study_week, COALESCE({O.tod_label('mode_idx')},
  (SELECT v FROM (SELECT {O.tod_label('mode_idx')} AS v, COUNT(*) AS c FROM wf WHERE mode_idx IS NOT NULL
                  GROUP BY 1 ORDER BY c DESC, v ASC LIMIT 1) m)) AS event_time_of_day_mode
FROM wf""", _WF_SQL))
def q_mode_impute(spark, sf_dir):
    wk = _weekly(spark, sf_dir).select("user_id", "study_week", "event_time_of_day_mode")
    return mode_fill(wk, ["event_time_of_day_mode"])


@register("iterative_impute")
def q_iterative_impute(spark, sf_dir):
    """Chained regression imputation of hour and interval on the clocked dose events."""
    cols = ["hour", "interval_s", "numtimes", "withinrange", "day_idx"]
    df = clocked_events(events(spark, sf_dir), SPEC).select(
        "user_id", "day_idx", "slot", *[F.col(c).cast("double").alias(c) for c in cols if c != "day_idx"])
    (out,) = chained_impute(df, [df], cols)
    return out


def _final_split(spark, sf_dir):
    fs = lagged_featureset(events(spark, sf_dir), "study_day", 3, SPEC, check_nulls=False)
    df = cut_lineage(fs.df)
    assert_no_nulls(df)
    feats = [c for c in df.columns if c not in (fs.id_col, fs.target_col)]
    tr, te = first_fold_split(df, fs.id_col, fs.target_col, seed=42)
    return tr, te, feats, fs


def _metric_rows(ptr, pte, method):
    p = ptr.withColumn("type", F.lit("train")).unionByName(pte.withColumn("type", F.lit("test")))
    m = classification_metrics(p, ["type"])
    return m.select(F.lit(method).alias("method"), "*")


def _train_predict(method, params):
    def q(spark, sf_dir):
        tr, te, feats, fs = _final_split(spark, sf_dir)
        ptr, pte, _, _ = train_test(tr, te, feats, fs.target_col, fs.id_col, method, 42, params=params,
                                     impute=False,  # feature set checked NULL-free
                                     nominal=list(fs.nominal_cols))
        return _metric_rows(ptr, pte, method)
    return q


# default classifiers of the analysis: depth-2 trees for the forest and boosting
register("train_predict_lr")(_train_predict("LogisticR", {"C": 1.0}))
register("train_predict_rf")(_train_predict("RF", {"n_estimators": 100, "max_depth": 2}))
register("train_predict_gbt")(_train_predict("XGB", {"n_estimators": 100, "max_depth": 2, "learning_rate": 0.3}))
register("train_predict_svm")(_train_predict("SVM", {"C": 1.0}))


@register("feature_selection")
def q_feature_selection(spark, sf_dir):
    """Features kept by the depth-1 forest importance rule on the final training split."""
    tr, _, feats, fs = _final_split(spark, sf_dir)
    keep = set(select_by_forest(tr, feats, fs.target_col, seed=42))
    return spark.createDataFrame([(f, f in keep) for f in feats], "feature string, selected boolean")


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """Logistic regression tuned for specificity over its full C grid, grouped inner folds."""
    tr, te, feats, fs = _final_split(spark, sf_dir)
    model = tune(tr, feats, fs.target_col, fs.id_col, "LogisticR", 42)
    keep = [fs.id_col, F.col(fs.target_col).cast("int").alias("y_true")]
    ptr = model.transform(tr.select(*keep, *[F.col(f"`{f}`") for f in feats]))
    pte = model.transform(te.select(*keep, *[F.col(f"`{f}`") for f in feats]))
    return _metric_rows(ptr, pte, "LogisticR").withColumn("regParam", F.lit(float(model.params["regParam"])))


def _tuned(method, grid):
    def q(spark, sf_dir):
        tr, te, feats, fs = _final_split(spark, sf_dir)
        ptr, pte, model, _ = train_test(tr, te, feats, fs.target_col, fs.id_col, method, 42, tuned=True, grid=grid, impute=False, nominal=list(fs.nominal_cols))
        return _metric_rows(ptr, pte, method).withColumns({k: F.lit(v) for k, v in model.params.items()})
    return q


# forest grid: the analysis's numbers of trees and depths up to sizes that a benchmark run can wait for
register("grid_search_rf")(_tuned("RF", {"n_estimators": [50, 100], "max_depth": [1, 2], "min_samples_leaf": [1]}))
# the analysis's whole boosted grid: 243 points on five inner folds
register("grid_search_gbt")(_tuned("XGB", GRIDS["XGB"]))


@register("repeated_cv")
def q_repeated_cv(spark, sf_dir):
    """Logistic regression, 5 runs (seeds 0..4) of 5 subject-grouped folds; pooled metrics per run and side."""
    fs = lagged_featureset(events(spark, sf_dir), "study_day", 3, SPEC, check_nulls=False)
    df = cut_lineage(fs.df)
    assert_no_nulls(df)
    feats = [c for c in df.columns if c not in (fs.id_col, fs.target_col)]
    mets, _, _ = repeated_cv(df, feats, fs.target_col, fs.id_col, "LogisticR", runs=5, k=5, params={"C": 1.0},
                             impute=False, nominal=list(fs.nominal_cols))
    return mets


@register("lag_tuning_curve")
def q_lag_tuning_curve(spark, sf_dir):
    """Specificity by lag count and forest depth on the weekly set: 1 and 2 lags, depth 2, 20 trees, one run of two folds."""
    fs = featureset(events(spark, sf_dir), "study_week", SPEC)
    fs = one_hot_featureset(fs, category_levels_for(SPEC))
    rows = tune_lags(fs.with_df(cut_lineage(fs.df)), lag_range=(1, 2), depth_range=(2,), runs=1, k=2, exclusion={"study_week": 0}, params={"n_estimators": 20})
    return lag_tuning_curve(rows)


def _day_lagged(spark, sf_dir):
    fs = lagged_featureset(events(spark, sf_dir), "study_day", 3, SPEC, check_nulls=False)
    df = cut_lineage(fs.df)
    assert_no_nulls(df)
    feats = [c for c in df.columns if c not in (fs.id_col, fs.target_col)]
    return fs, df, feats


@register("smote")
def q_smote(spark, sf_dir):
    """Daily lagged set topped up to balanced classes (5-NN SMOTE, all columns continuous)."""
    fs, df, feats = _day_lagged(spark, sf_dir)
    return smote(df, feats, fs.target_col, fs.id_col, k=5, seed=42)


@register("smote_nc")
def q_smote_nc(spark, sf_dir):
    """Same with the lagged time-of-day and weekday indicators as nominal columns (SMOTE-NC)."""
    fs, df, feats = _day_lagged(spark, sf_dir)
    return smote(df, feats, fs.target_col, fs.id_col, k=5, seed=42, nominal=list(fs.nominal_cols))
