"""Cohort, clock and horizon-feature queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.adherence import cohort_adherence_pct, whole_study_adherence
from ..operators.horizons import add_target, daily_features, period_features, weekly_adherence
from ..sources.events import dose_events
from . import oracle as O
from .cohort import analysis_events, clocked_events
from .registry import SPEC, events, portable, r6, register

# ---------------------------------------------------------------- step 1: slice
@register("weekly_adherence", O.with_cohort("""
SELECT user_id, study_week, CAST(SUM(n) AS BIGINT) AS n_events, ROUND(SUM(m) / 7.0, 6) AS adherence_rate,
       CAST(SUM(m) / 7.0 > 0.8 AS INTEGER) AS adherent
FROM (SELECT user_id, study_week, study_day, SUM(numtimes) AS n, MAX(withinrange) AS m
      FROM ded GROUP BY user_id, study_week, study_day) d
GROUP BY user_id, study_week"""))
def q_weekly_adherence(spark, sf_dir):
    df = weekly_adherence(analysis_events(events(spark, sf_dir), SPEC))
    return df.withColumn("adherence_rate", r6("adherence_rate"))


@register("daily_adherence", O.with_cohort("""
SELECT user_id, study_day, CAST(MAX(withinrange) AS DOUBLE) AS adherence_rate,
       CAST(MAX(withinrange) > 0.8 AS INTEGER) AS adherent
FROM ded GROUP BY user_id, study_day"""))
def q_daily_adherence(spark, sf_dir):
    df = analysis_events(events(spark, sf_dir), SPEC)
    out = df.groupBy("user_id", "study_day").agg(F.max("withinrange").cast("double").alias("adherence_rate"))
    return add_target(out)


_CLOCK_COLS = ("user_id", "date", "day_idx", "slot", "datetime", "numtimes", "interval_s", "withinrange", "hour",
               "time_of_day", "is_weekday", "study_day", "day_of_week", "study_week", "study_month", "used_today")


_CLOCK_SQL = {"time_of_day": O.tod_label("time_of_day_idx") + " AS time_of_day",
              "date": "strftime(date, '%Y-%m-%d') AS date", "hour": "CAST(hour AS DOUBLE) AS hour",
              "interval_s": "CAST(interval_s AS DOUBLE) AS interval_s"}


@register("study_clock", O.with_cohort(f"""
SELECT {', '.join(_CLOCK_SQL.get(c, c) for c in _CLOCK_COLS)}
FROM wo"""))
def q_study_clock(spark, sf_dir):
    df = clocked_events(events(spark, sf_dir), SPEC).select(*_CLOCK_COLS)
    return portable(df, doubles=("hour", "interval_s"), dates=("date",))


@register("whole_study_adherence", O.with_cohort("""
SELECT user_id, ROUND(AVG(withinrange), 6) AS mean_withinrange,
       CAST(AVG(withinrange) >= 0.8 AS INTEGER) AS adherent
FROM dose GROUP BY user_id"""))
def q_whole_study(spark, sf_dir):
    df = whole_study_adherence(dose_events(events(spark, sf_dir), SPEC))
    return df.withColumn("mean_withinrange", r6("mean_withinrange"))


_COHORT_SQL = """
adh AS (SELECT user_id, CAST(AVG(withinrange) >= 0.8 AS INTEGER) AS adherent FROM dose GROUP BY user_id),
coh AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')"""


@register("cohort_adherence_pct", O.with_cohort("""
SELECT 'all' AS cohort, COUNT(*) AS n_subjects, ROUND(AVG(adherent) * 100, 2) AS pct_adherent FROM adh
UNION ALL
SELECT 'cohort', COUNT(*), ROUND(AVG(adherent) * 100, 2) FROM adh WHERE user_id IN (SELECT user_id FROM coh)
UNION ALL
SELECT 'rest', COUNT(*), ROUND(AVG(adherent) * 100, 2) FROM adh WHERE user_id NOT IN (SELECT user_id FROM coh)""",
                                                  _COHORT_SQL))
def q_cohort_pct(spark, sf_dir):
    ev = events(spark, sf_dir)
    adh = whole_study_adherence(dose_events(ev, SPEC))
    cohort = ev.where(F.col("event_type") == "signup").select("user_id")
    return cohort_adherence_pct(adh, cohort)


# ---------------------------------------------------------------- step 3: horizon features
@register("slot_dedup", O.with_cohort("""
SELECT user_id, study_day, day_idx, slot, datetime, numtimes, CAST(interval_s AS DOUBLE) AS interval_s FROM ded"""))
def q_slot_dedup(spark, sf_dir):
    return portable(analysis_events(events(spark, sf_dir), SPEC).select(
        "user_id", "study_day", "day_idx", "slot", "datetime", "numtimes", "interval_s"), doubles=("interval_s",))


_FLAGS_SQL = ", ".join(
    f"MAX(CASE WHEN time_of_day_idx = {i} THEN 1 ELSE 0 END) AS time_of_day_{lab}"
    for i, lab in enumerate(SPEC.tod.labels))


@register("daily_features", O.with_cohort(f"""
SELECT user_id, study_day, CAST(SUM(numtimes) AS BIGINT) AS n_events,
       arg_min(is_weekday, slot) AS is_weekday, arg_min(day_of_week, slot) AS day_of_week,
       {_FLAGS_SQL},
       CAST(MAX(withinrange) AS DOUBLE) AS adherence_rate,
       CAST(MAX(withinrange) > 0.8 AS INTEGER) AS adherent
FROM ded GROUP BY user_id, study_day"""))
def q_daily_features(spark, sf_dir):
    return add_target(daily_features(analysis_events(events(spark, sf_dir), SPEC)))


@register("time_of_day_flags", O.with_cohort(f"""
SELECT user_id, study_day, {_FLAGS_SQL} FROM ded GROUP BY user_id, study_day"""))
def q_tod_flags(spark, sf_dir):
    return daily_features(analysis_events(events(spark, sf_dir), SPEC)).select(
        "user_id", "study_day", *[f"time_of_day_{lab}" for lab in SPEC.tod.labels])


def _period_sql(horizon: str, denom: int) -> tuple[str, str]:
    """Extra CTEs (gaps, per-day max, mode) and the SELECT for a period feature set."""
    ctes = f"""
g AS (
  SELECT *,
    date_diff('second', LAG(datetime) OVER (PARTITION BY user_id, {horizon} ORDER BY day_idx, slot), datetime) AS gap_s,
    row_number() OVER (PARTITION BY user_id, {horizon}, study_day ORDER BY day_idx, slot) AS day_rn,
    MAX(withinrange) OVER (PARTITION BY user_id, {horizon}, study_day) AS day_max
  FROM ded
),
mc AS (
  SELECT user_id, {horizon}, time_of_day_idx, COUNT(*) AS c FROM ded
  WHERE time_of_day_idx IS NOT NULL GROUP BY user_id, {horizon}, time_of_day_idx
),
md AS (
  SELECT user_id, {horizon}, arg_min(time_of_day_idx, (-c, time_of_day_idx)) AS mode_idx FROM mc
  GROUP BY user_id, {horizon}
),
pf AS (
  SELECT g.user_id, g.{horizon},
    CAST(SUM(numtimes) AS BIGINT) AS n_events,
    CAST(COALESCE(floor(AVG(hour)), 0) AS INTEGER) AS event_time_mean,
    CAST(COALESCE(floor(stddev_samp(hour)), 0) AS INTEGER) AS event_time_std,
    CAST(COALESCE(floor(abs(AVG(gap_s)) / 3600), 0) AS INTEGER) AS between_event_time_mean,
    CAST(COALESCE(floor(stddev_samp(gap_s) / 3600), 0) AS INTEGER) AS between_event_time_std,
    SUM(numtimes) / {float(denom)} AS num_daily_events_mean,
    SUM(CASE WHEN day_rn = 1 THEN day_max END) / {float(denom)} AS adherence_rate
  FROM g GROUP BY g.user_id, g.{horizon}
)"""
    select = f"""
SELECT pf.user_id, pf.{horizon}, n_events, event_time_mean, event_time_std, between_event_time_mean,
       between_event_time_std, ROUND(num_daily_events_mean, 6) AS num_daily_events_mean,
       {O.tod_label('md.mode_idx')} AS event_time_of_day_mode,
       ROUND(adherence_rate, 6) AS adherence_rate, CAST(adherence_rate > 0.8 AS INTEGER) AS adherent
FROM pf LEFT JOIN md ON md.user_id = pf.user_id AND md.{horizon} = pf.{horizon}"""
    return ctes, select


def _period_query(spark, sf_dir, horizon):
    df = add_target(period_features(analysis_events(events(spark, sf_dir), SPEC), horizon))
    return df.withColumns({"num_daily_events_mean": r6("num_daily_events_mean"),
                           "adherence_rate": r6("adherence_rate")})


_wk_ctes, _wk_sel = _period_sql("study_week", 7)


@register("weekly_features", O.with_cohort(_wk_sel, _wk_ctes))
def q_weekly_features(spark, sf_dir):
    return _period_query(spark, sf_dir, "study_week")


_mo_ctes, _mo_sel = _period_sql("study_month", 30)


@register("monthly_features", O.with_cohort(_mo_sel, _mo_ctes))
def q_monthly_features(spark, sf_dir):
    return _period_query(spark, sf_dir, "study_month")


@register("weekly_event_stats", O.with_cohort("""
SELECT user_id, study_week, event_time_mean, event_time_std, between_event_time_mean, between_event_time_std
FROM pf""", _wk_ctes))
def q_weekly_event_stats(spark, sf_dir):
    return _period_query(spark, sf_dir, "study_week").select(
        "user_id", "study_week", "event_time_mean", "event_time_std", "between_event_time_mean",
        "between_event_time_std")


@register("time_of_day_mode", O.with_cohort(f"""
SELECT pf.user_id, pf.study_week, {O.tod_label('md.mode_idx')} AS event_time_of_day_mode
FROM pf LEFT JOIN md ON md.user_id = pf.user_id AND md.study_week = pf.study_week""", _wk_ctes))
def q_tod_mode(spark, sf_dir):
    return _period_query(spark, sf_dir, "study_week").select("user_id", "study_week", "event_time_of_day_mode")
