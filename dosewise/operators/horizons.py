"""Per-(subject, horizon) aggregation of dose events.

All aggregates of one horizon share the grouping key, so each horizon is one
``groupBy().agg()`` (no chain of joins).  The weekly/monthly features also
need row-ordered gaps and a per-day max; both are windows partitioned by a
superset of ``(id, horizon)``, so Spark plans a single exchange on the group
key for the whole horizon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ADHERENCE_THRESHOLD, HORIZON_DENOMINATOR, TimeOfDayBins
from ..functions.temporal import seconds_between, time_of_day_label


def add_target(df: DataFrame, rate_col: str = "adherence_rate", target: str = "adherent",
               threshold: float = ADHERENCE_THRESHOLD, drop_rate: bool = False) -> DataFrame:
    """``target = 1 if rate > threshold`` (strict)."""
    out = df.withColumn(target, (F.col(rate_col) > F.lit(threshold)).cast("int"))
    return out.drop(rate_col) if drop_rate else out


def daily_features(df: DataFrame, id_col: str = "user_id", tod: TimeOfDayBins = TimeOfDayBins(),
                   per_day: bool = False) -> DataFrame:
    """One row per (subject, study_day).

    ``n_events`` sums the day count over the day's slot rows, as published;
    ``per_day=True`` takes the day count once.  ``is_weekday``/``day_of_week``
    come from the day's first slot row.  ``time_of_day_<label>`` flags whether
    any opening fell in that bin.
    """
    flags = [F.max(F.when(F.col("time_of_day_idx") == i, 1).otherwise(0)).alias(f"time_of_day_{lab}")
             for i, lab in enumerate(tod.labels)]
    n_events = F.max("numtimes").cast("bigint") if per_day else F.sum("numtimes").cast("bigint")
    return df.groupBy(id_col, "study_day").agg(
        n_events.alias("n_events"),
        F.min_by("is_weekday", "slot").alias("is_weekday"),
        F.min_by("day_of_week", "slot").alias("day_of_week"),
        *flags,
        F.max("withinrange").cast("double").alias("adherence_rate"),
    )


def period_features(df: DataFrame, horizon: str = "study_week", id_col: str = "user_id",
                    tod: TimeOfDayBins = TimeOfDayBins(), per_day: bool = False,
                    order=("day_idx", "slot")) -> DataFrame:
    """One row per (subject, week) or (subject, month).

    Hour statistics ignore empty slots; gaps are taken in row order, and a gap
    touching an empty slot is NULL (the chain breaks there).  Rates divide by
    the fixed period length, so partial periods count low, as published.
    """
    denom = float(HORIZON_DENOMINATOR[horizon])
    key = [id_col, horizon]
    w_gap = Window.partitionBy(*key).orderBy(*order)
    w_day = Window.partitionBy(*key, "study_day")
    first_of_day = F.row_number().over(w_day.orderBy(*order)) == 1
    rows = df.withColumns({
        "_gap_s": seconds_between(F.lag("datetime").over(w_gap), F.col("datetime")),
        "_day_max": F.when(first_of_day, F.max("withinrange").over(w_day)),
        "_day_n": F.when(first_of_day, F.max("numtimes").over(w_day)),
    })
    n_events = F.sum("_day_n") if per_day else F.sum("numtimes")
    mode_idx = F.mode("time_of_day_idx", True)
    return rows.groupBy(*key).agg(
        n_events.cast("bigint").alias("n_events"),
        F.coalesce(F.floor(F.avg("hour")), F.lit(0)).cast("int").alias("event_time_mean"),
        F.coalesce(F.floor(F.stddev_samp("hour")), F.lit(0)).cast("int").alias("event_time_std"),
        F.coalesce(F.floor(F.abs(F.avg("_gap_s")) / 3600), F.lit(0)).cast("int").alias("between_event_time_mean"),
        F.coalesce(F.floor(F.stddev_samp("_gap_s") / 3600), F.lit(0)).cast("int").alias("between_event_time_std"),
        (n_events / F.lit(denom)).alias("num_daily_events_mean"),
        time_of_day_label(mode_idx, tod).alias("event_time_of_day_mode"),
        (F.sum("_day_max") / F.lit(denom)).alias("adherence_rate"),
    )


def weekly_adherence(df: DataFrame, id_col: str = "user_id", horizon: str = "study_week") -> DataFrame:
    """Slim weekly slice: n_events, adherence_rate, adherent."""
    denom = float(HORIZON_DENOMINATOR[horizon])
    days = df.groupBy(id_col, horizon, "study_day").agg(
        F.sum("numtimes").alias("n"), F.max("withinrange").alias("m"))
    out = days.groupBy(id_col, horizon).agg(
        F.sum("n").cast("bigint").alias("n_events"), (F.sum("m") / F.lit(denom)).alias("adherence_rate"))
    return add_target(out)
