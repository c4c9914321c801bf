"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

Each text runs against the pre-registered table views.  Shared common table
expressions rebuild the dose-event cohort with the same rules as
``dosewise.sources.events``.
"""

from __future__ import annotations

from ..config import CohortSpec, TimeOfDayBins


def _tod_idx(expr: str, tod: TimeOfDayBins) -> str:
    parts = [f"WHEN {expr} > {tod.bins[i]} AND {expr} <= {tod.bins[i + 1]} THEN {i}" for i in range(len(tod.labels))]
    return "CASE " + " ".join(parts) + " END"


def tod_label(expr: str, tod: TimeOfDayBins = TimeOfDayBins()) -> str:
    parts = [f"WHEN {expr} = {i} THEN '{lab}'" for i, lab in enumerate(tod.labels)]
    return "CASE " + " ".join(parts) + " END"


def md5_int(expr: str) -> str:
    """First 8 hex digits of md5(text) as an integer (same value as Spark's conv)."""
    return f"CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8)) AS BIGINT)"


def cohort_ctes(spec: CohortSpec = CohortSpec()) -> str:
    """CTEs: ev, bnd, used, cap, used_i, cal, days, slots, dose, clock, wo, ded."""
    lo, hi = spec.within_range_s
    tod = _tod_idx("hour(datetime)", spec.tod)
    return f"""
ev AS (
  SELECT user_id, event_id, ts, CAST(ts AS DATE) AS date FROM events
  WHERE ts IS NOT NULL AND user_id IS NOT NULL
),
bnd AS (SELECT MIN(date) AS min_d, MAX(date) AS max_d FROM ev),
used AS (
  SELECT user_id, date, CAST(COUNT(*) AS INTEGER) AS numtimes, date_trunc('second', MIN(ts)) AS first_ts
  FROM ev GROUP BY user_id, date
),
cap AS (SELECT MAX(numtimes) AS k FROM used),
used_i AS (
  SELECT *, date_diff('second', LAG(first_ts) OVER (PARTITION BY user_id ORDER BY date), first_ts) AS interval_s
  FROM used
),
cal AS (
  SELECT u.user_id, u.enroll,
         CAST(unnest(generate_series(CAST(u.enroll AS TIMESTAMP), CAST(b.max_d AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT user_id, MIN(date) AS enroll FROM used GROUP BY user_id) u CROSS JOIN bnd b
),
days AS (
  SELECT c.user_id, c.enroll, c.date,
         CAST(date_diff('day', b.min_d, c.date) + 1 AS INTEGER) AS day_idx,
         CAST(COALESCE(u.numtimes, 0) AS INTEGER) AS numtimes, u.first_ts, u.interval_s,
         CAST(CASE WHEN u.interval_s BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS INTEGER) AS withinrange
  FROM cal c CROSS JOIN bnd b LEFT JOIN used_i u ON u.user_id = c.user_id AND u.date = c.date
),
slots AS (
  SELECT user_id, date, slot, datetime FROM (
    SELECT user_id, date, date_trunc('second', ts) AS datetime,
           CAST(row_number() OVER (PARTITION BY user_id, date ORDER BY ts, event_id) AS INTEGER) AS slot
    FROM ev) r
  UNION ALL
  SELECT user_id, date, numtimes + 1 AS slot, CAST(NULL AS TIMESTAMP) AS datetime
  FROM days WHERE enroll < date AND numtimes < (SELECT k FROM cap)
),
dose AS (
  SELECT d.user_id, d.enroll, d.date, d.day_idx, s.slot, s.datetime, d.numtimes, d.interval_s, d.withinrange
  FROM (SELECT user_id, date, datetime, MIN(slot) AS slot FROM slots GROUP BY user_id, date, datetime) s
  JOIN days d ON d.user_id = s.user_id AND d.date = s.date
  WHERE d.enroll < d.date
),
clock AS (
  SELECT *,
    CAST(hour(datetime) AS INTEGER) AS hour,
    {tod} AS time_of_day_idx,
    COALESCE(CAST(isodow(datetime) < 6 AS INTEGER), 1) AS is_weekday,
    CAST(date_diff('day', enroll, date) AS INTEGER) AS study_day,
    dayname(date) AS day_of_week,
    CAST(floor(date_diff('day', enroll, date) / 7) AS INTEGER) AS study_week,
    CAST(floor(date_diff('day', enroll, date) / 30) AS INTEGER) AS study_month,
    CAST(numtimes > 0 AS INTEGER) AS used_today
  FROM dose
),
wo AS (SELECT * FROM clock WHERE floor(study_day / {spec.washout_days}) > 0),
ded AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, study_day, interval_s ORDER BY day_idx, slot) AS rn FROM wo) x
  WHERE rn = 1 OR numtimes > 1
)"""


def with_cohort(body: str, extra_ctes: str = "", spec: CohortSpec = CohortSpec()) -> str:
    ctes = cohort_ctes(spec)
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
