"""Study parameters and fixed values.

Everything study-specific (rename maps, codebooks, cohort ids) is supplied by
the caller; only the generic analysis constants live here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must equal the analysis being reproduced) -----------------
# Hour bins are right-closed: (-1, 6], (6, 12], (12, 18], (18, 24].
TIME_OF_DAY_BINS = (-1, 6, 12, 18, 24)
TIME_OF_DAY_LABELS = ("early_morning", "morning", "afternoon", "evening")
DAYS_IN_WEEK = 7
DAYS_IN_MONTH = 30
SECONDS_IN_HOUR = 3600
ADHERENCE_THRESHOLD = 0.8  # horizon target: rate > 0.8 (strict)
WHOLE_STUDY_THRESHOLD = 0.8  # whole-study flag: mean >= 0.8 (non-strict)
WASHOUT_DAYS = 30
ROC_GRID_POINTS = 100
CORRELATION_DROP_R = 0.85
ATTRIBUTION_SAMPLE_MAX = 1000
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
HORIZON_DENOMINATOR = {"study_week": DAYS_IN_WEEK, "study_month": DAYS_IN_MONTH}
LAG_TUNING_EXCLUSION = {"study_day": 30, "study_week": 4, "study_month": 1}
# --- end fixed values ---------------------------------------------------------


@dataclass(frozen=True)
class TimeOfDayBins:
    bins: tuple = TIME_OF_DAY_BINS
    labels: tuple = TIME_OF_DAY_LABELS

    def __post_init__(self):
        if len(self.bins) != len(self.labels) + 1:
            raise ValueError("need one more bin edge than labels")


@dataclass(frozen=True)
class CohortSpec:
    """How the `events` table is read as a dose-event (pill-bottle) study.

    Every event counts as one bottle opening, and every opening is kept.  The
    day capacity (time columns per day of the wide export) is the largest daily
    count of the data.
    """

    id_col: str = "user_id"
    ts_col: str = "ts"
    order_col: str = "event_id"
    within_range_s: tuple = (8 * 3600, 40 * 3600)
    washout_days: int = 7
    tod: TimeOfDayBins = field(default_factory=TimeOfDayBins)
