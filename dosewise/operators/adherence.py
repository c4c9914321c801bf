"""Whole-study adherence and cohort comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WHOLE_STUDY_THRESHOLD


def whole_study_adherence(df: DataFrame, id_col: str = "user_id", col: str = "withinrange",
                          threshold: float = WHOLE_STUDY_THRESHOLD) -> DataFrame:
    """Per subject: mean of ``col`` over all rows, adherent when mean >= threshold."""
    return df.groupBy(id_col).agg(F.avg(col).alias("mean_withinrange")).withColumn(
        "adherent", (F.col("mean_withinrange") >= F.lit(threshold)).cast("int"))


def cohort_split(df: DataFrame, cohort: DataFrame, id_col: str = "user_id"):
    """(members, non-members) of a cohort id table: semi and anti joins.

    The cohort table is one row per id; the planner broadcasts it only when its
    runtime size is under the broadcast threshold (AQE), otherwise it shuffles.
    """
    ids = cohort.select(id_col).distinct()
    return df.join(ids, id_col, "left_semi"), df.join(ids, id_col, "left_anti")


def percent_adherent(df: DataFrame, col: str = "adherent", by=None) -> DataFrame:
    """round(mean(col) * 100, 2) and subject count, optionally per group."""
    aggs = [F.count(F.lit(1)).alias("n_subjects"), F.round(F.avg(col) * 100, 2).alias("pct_adherent")]
    return df.groupBy(*(by or [])).agg(*aggs)


def cohort_adherence_pct(adherence: DataFrame, cohort: DataFrame, id_col: str = "user_id",
                         col: str = "adherent") -> DataFrame:
    """Percent adherent overall, inside and outside a cohort (three rows)."""
    inside, outside = cohort_split(adherence, cohort, id_col)
    parts = [("all", adherence), ("cohort", inside), ("rest", outside)]
    out = None
    for name, part in parts:
        p = percent_adherent(part, col).select(F.lit(name).alias("cohort"), "n_subjects", "pct_adherent")
        out = p if out is None else out.unionByName(p)
    return out
