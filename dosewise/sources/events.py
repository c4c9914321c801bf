"""Read an ``events`` table as a dose-event study.

The study analysis expects one row per (patient, monitored day, recorded
opening) -- the long form of a wide monitor export.  This module derives that
long form straight from an event log, with the rules documented in
``CohortSpec``:

* enrollment = first event date of the user; every calendar date from
  enrollment to the last date of the table is a monitored day (non-use days
  included);
* a day keeps all its openings, ordered by (ts, event_id); when it has fewer
  than the largest daily count of the data (the day capacity of the wide
  layout), one empty (NULL time) slot row marks the unused capacity, which is
  exactly what melting a wide day group and removing duplicate rows gives;
* ``interval_s`` = seconds from the first opening of the user's previous used
  day to the first opening of this day; ``withinrange`` = interval inside the
  prescribed window.

Scale notes: the per-(user, day) counts are partial aggregates (map-side
combine), so a hot user/day costs one combiner row per map task.  Openings stay
rows (no per-day arrays); a window numbers them per (user, day), so a user's
days spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CohortSpec
from ..functions.temporal import seconds_between


def _events(events: DataFrame, spec: CohortSpec) -> DataFrame:
    return events.select(
        F.col(spec.id_col), F.col(spec.order_col), F.col(spec.ts_col).cast("timestamp_ntz").alias("ts"),
    ).where(F.col("ts").isNotNull() & F.col(spec.id_col).isNotNull()).withColumn("date", F.to_date("ts"))


def _bounds(ev: DataFrame):
    """(first, last) event date of the table as ONE scalar subquery (reused for both)."""
    b = ev.select(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    return b.getField("lo"), b.getField("hi")


def day_capacity(events: DataFrame, spec: CohortSpec = CohortSpec()):
    """Largest number of openings of one user on one day, as a scalar subquery."""
    counts = _events(events, spec).groupBy(spec.id_col, "date").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.max("n").cast("int")).scalar()


def daily_use(events: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """One row per (user, calendar day) from enrollment to the table's last date.

    Columns: id, enroll, date, day_idx, numtimes, first_ts, interval_s, withinrange.

    Plan: one partial aggregate per (user, day); one window per user gives the
    enrollment date, the interval since the previous used day and the next
    used day, and each used day then emits itself plus the non-use days up to
    the next used day (one generator -- no calendar table, no join).  Per-user
    partitions hold one row per used day, bounded by the study length.
    """
    idc = spec.id_col
    ev = _events(events, spec)
    min_d, max_d = _bounds(ev)
    used = ev.groupBy(idc, "date").agg(
        F.count(F.lit(1)).cast("int").alias("numtimes"),
        F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("first_ts"),
    )
    w = Window.partitionBy(idc).orderBy("date")
    used = used.select(
        idc, "date", "numtimes", "first_ts",
        seconds_between(F.lag("first_ts").over(w), F.col("first_ts")).alias("interval_s"),
        F.lead("date").over(w).alias("_next"),
        F.min("date").over(Window.partitionBy(idc)).alias("enroll"),
    )
    # materialise the gap bounds first: a subquery may not sit inside a higher-order function
    used = used.withColumn("_gap_hi", F.coalesce(F.date_sub("_next", 1), max_d))
    gap_lo = F.date_add("date", 1)
    gap_days = F.when(gap_lo <= F.col("_gap_hi"), F.sequence(gap_lo, F.col("_gap_hi"))) \
        .otherwise(F.array().cast("array<date>"))
    day = F.struct(F.col("date").alias("d"), F.col("numtimes").alias("n"), F.col("first_ts").alias("f"),
                   F.col("interval_s").alias("i"))
    idle = F.transform(gap_days, lambda d: F.struct(d.alias("d"), F.lit(0).alias("n"),
                                                    F.lit(None).cast("timestamp_ntz").alias("f"),
                                                    F.lit(None).cast("bigint").alias("i")))
    days = used.select(idc, "enroll", F.explode(F.concat(F.array(day), idle)).alias("x"))
    lo, hi = spec.within_range_s
    return days.select(
        idc, "enroll", F.col("x.d").alias("date"),
        (F.datediff(F.col("x.d"), min_d) + 1).alias("day_idx"),
        F.col("x.n").alias("numtimes"), F.col("x.f").alias("first_ts"), F.col("x.i").alias("interval_s"),
        F.coalesce(F.col("x.i").between(lo, hi).cast("int"), F.lit(0)).alias("withinrange"),
    )


def slot_openings(events: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """All openings of each (user, day), numbered in order: id, date, slot, datetime."""
    idc = spec.id_col
    ev = _events(events, spec)
    w = Window.partitionBy(idc, "date").orderBy("ts", spec.order_col)
    return (
        ev.withColumn("slot", F.row_number().over(w))
        .select(idc, "date", "slot", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("datetime"))
    )


def dose_events(events: DataFrame, spec: CohortSpec = CohortSpec(), after_enrollment: bool = True) -> DataFrame:
    """Long dose-event table (one row per user, day, distinct recorded time).

    Columns: id, enroll, date, day_idx, slot, datetime, numtimes, interval_s, withinrange.
    ``after_enrollment`` keeps only days strictly after the enrollment day.

    Openings are joined to their day row and de-duplicated to distinct seconds;
    the first row of a day with spare capacity also emits the empty-slot marker.
    """
    idc = spec.id_col
    days = daily_use(events, spec)
    if after_enrollment:
        days = days.where(F.col("enroll") < F.col("date"))
    w = Window.partitionBy(idc, "date").orderBy("slot")
    ops = slot_openings(events, spec).withColumn("_last", F.lag("datetime").over(w))
    ops = ops.where(F.col("_last").isNull() | (F.col("_last") != F.col("datetime"))).drop("_last")
    j = days.drop("first_ts").join(ops, [idc, "date"], "left").withColumn("_cap", day_capacity(events, spec))
    slot_t = "array<struct<slot:int,datetime:timestamp_ntz>>"
    own = F.when(F.col("slot").isNotNull(), F.array(F.struct("slot", "datetime")))
    marker = F.when((F.coalesce(F.col("slot"), F.lit(1)) == 1) & (F.col("numtimes") < F.col("_cap")), F.array(F.struct(
        (F.col("numtimes") + 1).alias("slot"), F.lit(None).cast("timestamp_ntz").alias("datetime"))))
    none = F.array().cast(slot_t)
    out = j.withColumn("_o", F.explode(F.concat(F.coalesce(own, none), F.coalesce(marker, none)))).drop("slot", "datetime")
    return out.select(idc, "enroll", "date", "day_idx", F.col("_o.slot").alias("slot"),
                      F.col("_o.datetime").alias("datetime"), "numtimes", "interval_s", "withinrange")


def export_size(events: DataFrame, spec: CohortSpec = CohortSpec()) -> tuple[int, int]:
    """(days, time columns per day) of the wide export: the calendar's length and the day capacity."""
    ev = _events(events, spec)
    days = ev.agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("n")).first()["n"]
    slots = ev.groupBy(spec.id_col, "date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return days or 0, slots or 0


#: Patterns of the wide export's columns, for ``wide_to_long``: any number of days and slots.
EXPORT_DATE_RE = r"^date(\d{3,})$"
EXPORT_SLOT_RE = r"^MEMS_{date}_time\d+$"


def wide_export(events: DataFrame, spec: CohortSpec = CohortSpec(), n_days: int | None = None,
                n_slots: int | None = None) -> DataFrame:
    """Pivot the event log into the wide monitor layout (one row per user).

    Columns: ``PtID``, ``DateEnroll`` (M/D/YYYY text) and per study-calendar day
    ``ddd`` (1-based ``day_idx``, three digits or more): ``dateddd``,
    ``MEMS_dateddd_time0..k-1``, ``MEMS_dateddd_numtimes`` and, from the second
    day on, ``MEMS_dateddd_interval`` / ``MEMS_dateddd_withinrange``.  Cells are
    text, as in a CSV export.  The numbers of days and slots come from the data
    unless given; fewer than the data has is an error, not a cut.
    """
    days_there, slots_there = export_size(events, spec)
    n_days = days_there if n_days is None else n_days
    n_slots = slots_there if n_slots is None else n_slots
    if n_days < days_there or n_slots < slots_there:
        raise ValueError(f"the data has {days_there} days of up to {slots_there} openings")
    idc = spec.id_col
    days = daily_use(events, spec)
    slots = slot_openings(events, spec)
    itv = F.when(F.col("interval_s").isNotNull(), F.concat(
        F.floor(F.col("interval_s") / 86400).cast("string"), F.lit(" days "),
        F.date_format(F.timestamp_seconds(F.col("interval_s") % 86400), "HH:mm:ss")))
    per_day = days.join(slots, [idc, "date"], "left").groupBy(idc, "enroll", "date", "day_idx").agg(
        F.first("numtimes").cast("string").alias("n"),
        F.first(itv).alias("i"),
        F.first("withinrange").cast("string").alias("w"),
        F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct(
            "slot", F.date_format("datetime", "HH:mm:ss"))))).alias("t"),
    )
    # one row per user holding a day -> cells map (bounded by the study length),
    # then every wide column is a plain projection of that map
    per_user = per_day.groupBy(idc).agg(
        F.date_format(F.min("enroll"), "M/d/yyyy").alias("DateEnroll"),
        F.map_from_entries(F.collect_list(F.struct(
            "day_idx", F.struct(F.date_format("date", "MM/dd/yyyy").alias("d"), "n", "i", "w", "t")))).alias("_days"))
    # projection as SQL text: hundreds of columns plan far faster than Column objects
    cols = [f"`{idc}` AS PtID", "DateEnroll"]
    for d in range(1, n_days + 1):
        tag = f"date{d:03d}"
        day = f"try_element_at(_days, {d})"
        cols.append(f"{day}.d AS {tag}")
        cols += [f"try_element_at({day}.t, {s}) AS MEMS_{tag}_time{s - 1}" for s in range(1, n_slots + 1)]
        cols.append(f"{day}.n AS MEMS_{tag}_numtimes")
        if d > 1:
            cols += [f"{day}.i AS MEMS_{tag}_interval", f"{day}.w AS MEMS_{tag}_withinrange"]
    return per_user.selectExpr(*cols)
