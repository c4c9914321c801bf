"""Study clock, washout, slot dedup and horizon aggregates on hand rows."""

import datetime as dt

from pyspark.sql import functions as F

from dosewise.operators.clock import study_clock, washout
from dosewise.operators.dedup import dedup_slots
from dosewise.operators.horizons import add_target, daily_features, period_features

D = dt.date
T = dt.datetime
SCHEMA = ("user_id long, enroll date, date date, day_idx int, slot int, datetime timestamp_ntz, numtimes int, "
          "interval_s long, withinrange int")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_hour_bins_and_weekday_rule(spark):
    hours = [0, 6, 7, 12, 13, 18, 19, 23]
    rows = [(1, D(2024, 1, 1), D(2024, 1, 3), 3, i + 1, T(2024, 1, 3, h, 0, 0), 8, None, 0) for i, h in enumerate(hours)]
    # a non-use Sunday: NULL time -> counted as weekday (published rule)
    rows.append((1, D(2024, 1, 1), D(2024, 1, 7), 7, 1, None, 0, None, 0))
    out = study_clock(_rows(spark, rows)).orderBy("date", "slot").collect()
    assert [r.time_of_day for r in out[:8]] == ["early_morning", "early_morning", "morning", "morning", "afternoon",
                                                "afternoon", "evening", "evening"]
    assert out[8].is_weekday == 1 and out[8].day_of_week == "Sunday"
    alt = study_clock(_rows(spark, rows), weekday_from="date").orderBy("date", "slot").collect()
    assert alt[8].is_weekday == 0
    assert out[0].study_day == 2 and out[0].study_week == 0 and out[0].study_month == 0
    assert out[0].used_today == 1 and out[8].used_today == 0


def test_washout_keeps_whole_periods(spark):
    rows = [(1, D(2024, 1, 1), D(2024, 1, 1) + dt.timedelta(days=k), k + 1, 1, None, 0, None, 0) for k in range(1, 40)]
    c = study_clock(_rows(spark, rows))
    assert washout(c, 30).agg(F.min("study_day")).first()[0] == 30
    assert washout(c, 7).agg(F.min("study_day")).first()[0] == 7


def _day(numtimes, times, day=10, interval=90000, wr=1):
    rows = []
    for s, t in enumerate(times, start=1):
        rows.append((1, D(2024, 1, 1), D(2024, 1, day), day, s, t, numtimes, interval, wr))
    return rows


def test_dedup_and_n_events_quirk(spark):
    t = T(2024, 1, 10, 8, 0, 0)
    rows = (_day(0, [None], day=10, interval=None, wr=0)
            + _day(1, [t.replace(day=11), None], day=11)
            + _day(2, [t.replace(day=12), t.replace(day=12, hour=20), None], day=12)
            + _day(3, [t.replace(day=13), t.replace(day=13, hour=12), t.replace(day=13, hour=21), None], day=13))
    c = dedup_slots(study_clock(_rows(spark, rows)))
    d = {r.study_day: r for r in daily_features(c).collect()}
    # k <= 1 -> k; k >= 2 -> k x (distinct times + 1 for the empty slot)
    assert [d[k].n_events for k in (9, 10, 11, 12)] == [0, 1, 6, 12]
    per = {r.study_day: r.n_events for r in daily_features(c, per_day=True).collect()}
    assert [per[k] for k in (9, 10, 11, 12)] == [0, 1, 2, 3]
    assert d[12].time_of_day_early_morning == 0 and d[12].time_of_day_morning == 1
    assert d[12].time_of_day_afternoon == 0 and d[12].time_of_day_evening == 1


def test_period_features_gaps_mode_and_rate(spark):
    # week 1 (days 7..13): day 8 has times 06:00 and 08:00, day 9 empty, day 10 at 07:00
    rows = [(1, D(2024, 1, 1), D(2024, 1, 8), 8, 1, T(2024, 1, 8, 6), 2, 3600, 1),
            (1, D(2024, 1, 1), D(2024, 1, 8), 8, 2, T(2024, 1, 8, 8), 2, 3600, 1),
            (1, D(2024, 1, 1), D(2024, 1, 8), 8, 3, None, 2, 3600, 1),
            (1, D(2024, 1, 1), D(2024, 1, 9), 9, 1, None, 0, None, 0),
            (1, D(2024, 1, 1), D(2024, 1, 10), 10, 1, T(2024, 1, 10, 7), 1, 172800, 0)]
    c = study_clock(_rows(spark, rows))
    r = add_target(period_features(c, "study_week")).first()
    assert r.study_week == 1
    assert r.n_events == 7  # 2+2+2 (slot rows of day 8) + 0 + 1
    assert r.event_time_mean == 7 and r.event_time_std == 1  # hours 6, 8, 7
    # only one non-null gap (08:00 - 06:00) because empty slots break the chain
    assert r.between_event_time_mean == 2 and r.between_event_time_std == 0
    # tie between early_morning (6, 8?) -> 6 is early_morning, 7 and 8 are morning -> morning wins 2:1
    assert r.event_time_of_day_mode == "morning"
    assert abs(r.adherence_rate - 1 / 7) < 1e-12 and r.adherent == 0
    assert abs(r.num_daily_events_mean - 1.0) < 1e-12


def test_mode_tie_takes_earliest_bin(spark):
    rows = [(1, D(2024, 1, 1), D(2024, 1, 8), 8, 1, T(2024, 1, 8, 5), 2, 3600, 1),
            (1, D(2024, 1, 1), D(2024, 1, 8), 8, 2, T(2024, 1, 8, 20), 2, 3600, 1)]
    r = period_features(study_clock(_rows(spark, rows)), "study_week").first()
    assert r.event_time_of_day_mode == "early_morning"


def test_whole_study_threshold_is_non_strict(spark):
    from dosewise.operators.adherence import cohort_adherence_pct, whole_study_adherence
    rows = [(1, 1), (1, 1), (1, 1), (1, 1), (1, 0), (2, 0), (2, 1)]
    df = spark.createDataFrame(rows, "user_id long, withinrange int")
    got = {r.user_id: r.adherent for r in whole_study_adherence(df).collect()}
    assert got == {1: 1, 2: 0}
    cohort = spark.createDataFrame([(1,)], "user_id long")
    pct = {r.cohort: (r.n_subjects, r.pct_adherent) for r in
           cohort_adherence_pct(whole_study_adherence(df), cohort).collect()}
    assert pct == {"all": (2, 50.0), "cohort": (1, 100.0), "rest": (1, 0.0)}
