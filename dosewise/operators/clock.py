"""Study clock: place dose events on per-subject study time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAYS_IN_MONTH, DAYS_IN_WEEK, WASHOUT_DAYS, TimeOfDayBins
from ..functions import temporal as T


def study_clock(df: DataFrame, date_col: str = "date", ts_col: str = "datetime", enroll_col: str = "enroll",
                numtimes_col: str = "numtimes", tod: TimeOfDayBins = TimeOfDayBins(),
                weekday_from: str = "ts") -> DataFrame:
    """Add hour, time_of_day(+_idx), is_weekday, study_day, day_of_week,
    study_week, study_month and used_today.

    ``weekday_from='ts'`` reproduces the analysis as published: the weekday flag
    is taken from the event timestamp, so a non-use day (NULL time) counts as a
    weekday; ``'date'`` takes it from the calendar date instead.
    """
    days = T.whole_days(enroll_col, date_col)
    wk_src = F.col(ts_col) if weekday_from == "ts" else F.col(date_col).cast("timestamp_ntz")
    hour = F.hour(ts_col)
    return df.withColumns({
        "hour": hour,
        "time_of_day_idx": T.time_of_day_index(hour, tod),
        "is_weekday": T.is_weekday(wk_src),
        "study_day": days,
        "day_of_week": T.day_name(date_col),
        "study_week": T.period_index(days, DAYS_IN_WEEK),
        "study_month": T.period_index(days, DAYS_IN_MONTH),
        "used_today": (F.col(numtimes_col) > 0).cast("int"),
    }).withColumn("time_of_day", T.time_of_day_label("time_of_day_idx", tod))


def washout(df: DataFrame, washout_days: int = WASHOUT_DAYS, day_col: str = "study_day") -> DataFrame:
    """Keep rows with at least ``washout_days`` whole days since enrollment."""
    return df.where(F.floor(F.col(day_col) / F.lit(washout_days)) > 0)


def horizon_exclusion(df: DataFrame, horizon: str, threshold: int) -> DataFrame:
    """Lag-tuning ramp-up exclusion: keep ``horizon > threshold``."""
    return df.where(F.col(horizon) > threshold)
