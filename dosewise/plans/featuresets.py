"""Per-horizon feature sets as used for modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DAY_NAMES, CohortSpec
from ..operators.horizons import add_target, daily_features, period_features
from ..operators.lagging import FeatureSet, prepare
from .cohort import analysis_events

# columns the analysis drops after its collinearity review
ANALYST_DROPS = {
    "study_day": ("n_events",),
    "study_week": ("n_events", "between_event_time_mean", "num_daily_events_mean"),
    "study_month": ("n_events", "between_event_time_mean", "num_daily_events_mean"),
}


def featureset(events: DataFrame, horizon: str, spec: CohortSpec = CohortSpec(), analyst_drops: bool = True,
               rows: DataFrame | None = None) -> FeatureSet:
    rows = rows if rows is not None else analysis_events(events, spec)
    tod = list(spec.tod.labels)
    if horizon == "study_day":
        df = daily_features(rows, spec.id_col, spec.tod)
        nominal = tuple(f"time_of_day_{lab}" for lab in tod) + ("adherent",)
        cats = ("day_of_week",)
    else:
        df = period_features(rows, horizon, spec.id_col, spec.tod)
        nominal = ("adherent",)
        cats = ("event_time_of_day_mode",)
    df = add_target(df, drop_rate=True)
    if analyst_drops:
        df = df.drop(*ANALYST_DROPS[horizon])
    return FeatureSet(df=df, name=horizon, id_col=spec.id_col, target_col="adherent", horizon=horizon,
                      nominal_cols=nominal, categorical_cols=cats)


def category_levels_for(spec: CohortSpec = CohortSpec()) -> dict:
    return {"day_of_week": list(DAY_NAMES), "event_time_of_day_mode": list(spec.tod.labels)}


def lagged_featureset(events: DataFrame, horizon: str, n_lags: int = 3, spec: CohortSpec = CohortSpec(),
                      check_nulls: bool = False) -> FeatureSet:
    fs = featureset(events, horizon, spec)
    return prepare(fs, n_lags=n_lags, levels=category_levels_for(spec), check_nulls=check_nulls)
