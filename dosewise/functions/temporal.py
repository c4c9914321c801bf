"""Date/time column functions (all JVM-side, codegen friendly).

Every function takes and returns ``Column`` expressions.  Parsing uses the
``try_*`` family so that bad input becomes NULL instead of failing the job
under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TimeOfDayBins


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_datetime(date_str, time_str, fmt: str = "M/d/yyyy H:m:s") -> Column:
    """``date + ' ' + time`` parsed with month/day/year hour:min:sec; NULL in, NULL out.

    ``concat`` (not ``concat_ws``) keeps a NULL time NULL.
    """
    s = F.concat(_c(date_str), F.lit(" "), _c(time_str))
    return F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")


def parse_date(s, fmt: str = "M/d/yyyy") -> Column:
    """Coercing date parse: failures become NULL."""
    return F.to_date(F.try_to_timestamp(_c(s), F.lit(fmt)))


def interval_seconds(s) -> Column:
    """``'D days HH:MM:SS'`` / ``'HH:MM:SS'`` duration text to seconds (BIGINT); junk -> NULL."""
    c = F.trim(_c(s))
    pat = r"^(?:(-?\d+) days?,? ?)?(\d+):(\d{1,2}):(\d{1,2})(?:\.\d+)?$"
    ok = c.rlike(pat)
    days = F.coalesce((F.regexp_extract(c, pat, 1)).try_cast("bigint"), F.lit(0))
    hh = (F.regexp_extract(c, pat, 2)).try_cast("bigint")
    mm = (F.regexp_extract(c, pat, 3)).try_cast("bigint")
    ss = (F.regexp_extract(c, pat, 4)).try_cast("bigint")
    return F.when(ok, days * 86400 + hh * 3600 + mm * 60 + ss)


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (BIGINT)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def time_of_day_index(hour, tod: TimeOfDayBins = TimeOfDayBins()) -> Column:
    """Right-closed hour bins -> 0-based bin index; outside all bins -> NULL."""
    h = _c(hour)
    expr = None
    for i in range(len(tod.labels)):
        cond = (h > tod.bins[i]) & (h <= tod.bins[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def time_of_day_label(idx, tod: TimeOfDayBins = TimeOfDayBins()) -> Column:
    """Bin index -> label (NULL stays NULL)."""
    i = _c(idx)
    expr = None
    for k, lab in enumerate(tod.labels):
        expr = F.when(i == k, F.lit(lab)) if expr is None else expr.when(i == k, F.lit(lab))
    return expr


def is_weekday(ts) -> Column:
    """1 Monday-Friday, 0 weekend.  A NULL timestamp counts as a weekday (1)."""
    return F.coalesce((F.weekday(_c(ts)) < 5).cast("int"), F.lit(1))


def day_name(d) -> Column:
    """Full English day name of a date."""
    return F.date_format(_c(d), "EEEE")


def whole_days(start, end) -> Column:
    """Whole calendar days from ``start`` to ``end`` (INT)."""
    return F.datediff(_c(end), _c(start))


def period_index(days, period_days: int) -> Column:
    """floor(days / period) as INT (study_week for 7, study_month for 30)."""
    return F.floor(_c(days) / F.lit(period_days)).cast("int")
