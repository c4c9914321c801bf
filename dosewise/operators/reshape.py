"""Wide monitor export -> long dose events.

The wide layout has one row per subject and one column group per monitored
day: ``dateDDD`` plus ``MEMS_dateDDD_time#``, ``_numtimes``, ``_interval``,
``_withinrange``.  The schema is discovered from the column names at plan
time and the whole unpivot is ONE generator expression:
``explode(array(named_struct(...day...)))`` then ``posexplode(times)``.  The
expression is built as SQL text because constructing thousands of ``Column``
objects in Python is several times slower to plan than parsing one string.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import interval_seconds, parse_date, parse_datetime


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def day_groups(columns, date_re: str = r"^date(\d{3})$", slot_re: str = r"^MEMS_{date}_time\d$"):
    """Plan-time discovery: [(day_number, date_col, [time cols], numtimes, interval, withinrange)]."""
    cols = set(columns)
    out = []
    for c in columns:
        m = re.search(date_re, c)
        if not m:
            if re.fullmatch(r"date\d+", c):
                raise ValueError(f"day column {c} does not match {date_re}; pass a date_re that does")
            continue
        day = int(m.group(1))
        times = [t for t in columns if re.search(slot_re.format(date=re.escape(c)), t)]
        pre = f"MEMS_{c}_"
        out.append((day, c, times,
                    pre + "numtimes" if pre + "numtimes" in cols else None,
                    pre + "interval" if pre + "interval" in cols else None,
                    pre + "withinrange" if pre + "withinrange" in cols else None))
    return out


def wide_to_long(df: DataFrame, id_col: str = "PtID", enroll_col: str = "DateEnroll",
                 date_re: str = r"^date(\d{3})$", slot_re: str = r"^MEMS_{date}_time\d$",
                 date_fmt: str = "M/d/yyyy", after_enrollment: bool = True) -> DataFrame:
    """Unpivot day groups to one row per (subject, day, distinct slot value).

    Output: id, enroll, date, day_idx, slot, time, datetime, numtimes,
    interval_s, withinrange.  Rows with an unparseable/NULL date are dropped;
    NULL times are kept (a recorded non-use day).  Exact duplicate rows (same
    subject, day and time) collapse to the first slot.  ``after_enrollment``
    keeps days strictly after enrollment.
    """
    groups = day_groups(df.columns, date_re, slot_re)
    if not groups:
        raise ValueError("no day column groups found")
    structs = []
    for day, dcol, times, num, itv, wr in groups:
        if not times:
            continue  # a day without slot columns yields no rows
        if num is None:
            raise KeyError(f"missing numtimes column for {dcol}")
        structs.append(
            "named_struct('day_idx', {d}, 'date', CAST({dc} AS STRING), 'numtimes', CAST({n} AS STRING), "
            "'interval', {i}, 'withinrange', {w}, 'times', array({t}))".format(
                d=day, dc=_q(dcol), n=_q(num),
                i=f"CAST({_q(itv)} AS STRING)" if itv else "CAST(NULL AS STRING)",
                w=f"CAST({_q(wr)} AS STRING)" if wr else "CAST(NULL AS STRING)",
                t=", ".join(f"CAST({_q(t)} AS STRING)" for t in times)))
    days = df.selectExpr(f"{_q(id_col)} AS _id", f"CAST({_q(enroll_col)} AS STRING) AS _enroll",
                         f"explode(array({', '.join(structs)})) AS d")
    rows = days.selectExpr("_id", "_enroll", "d.day_idx AS day_idx", "d.date AS _date", "d.numtimes AS _n",
                           "d.interval AS _itv", "d.withinrange AS _wr", "posexplode(d.times) AS (_pos, time)")
    long = rows.select(
        F.col("_id").alias(id_col),
        parse_date(F.col("_enroll"), date_fmt).alias("enroll"),
        parse_date(F.col("_date"), date_fmt).alias("date"),
        F.col("day_idx").cast("int").alias("day_idx"),
        (F.col("_pos") + 1).cast("int").alias("slot"),
        F.col("time"),
        parse_datetime(F.col("_date"), F.col("time"), date_fmt + " H:m:s").alias("datetime"),
        F.coalesce((F.col("_n")).try_cast("double").cast("int"), F.lit(0)).alias("numtimes"),
        interval_seconds(F.col("_itv")).alias("interval_s"),
        F.coalesce((F.col("_wr")).try_cast("double").cast("int"), F.lit(0)).alias("withinrange"),
    ).where(F.col("date").isNotNull())
    keys = [c for c in long.columns if c != "slot"]
    long = long.groupBy(*keys).agg(F.min("slot").alias("slot"))
    if after_enrollment:
        long = long.where(F.col("enroll") < F.col("date"))
    return long.select(id_col, "enroll", "date", "day_idx", "slot", "time", "datetime", "numtimes",
                       "interval_s", "withinrange")

