"""Composed plans from the ``events`` table to per-horizon feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import CohortSpec
from ..operators.clock import study_clock, washout
from ..operators.dedup import dedup_slots
from ..sources.events import dose_events


def clocked_events(events: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Dose events after enrollment, on the study clock, after washout (before slot dedup).

    One hash exchange on the subject id here serves every later window and
    aggregate keyed by (subject, ...): slot dedup, gaps, day and period
    aggregates.  Rows per subject are bounded (days x (slots + 1)), so the
    subject key cannot be skewed after the slot cap.
    """
    df = study_clock(dose_events(events, spec).repartition(spec.id_col), tod=spec.tod)
    return washout(df, spec.washout_days)


def analysis_events(events: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Rows the horizon aggregates run on: clocked, washed out, slot-deduplicated."""
    return dedup_slots(clocked_events(events, spec), keys=(spec.id_col, "study_day", "interval_s"))
