"""Row de-duplication rules with explicit, total orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_slots(df: DataFrame, keys=("user_id", "study_day", "interval_s"), order=("day_idx", "slot"),
                count_col: str = "numtimes") -> DataFrame:
    """Drop the 2nd+ row of each ``keys`` group when the day had at most one use.

    NULL keys compare equal (window partitions group NULLs together).  Groups
    are one subject-day, so partitions are bounded by the slot count.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = F.row_number().over(w)
    return df.withColumn("_rn", rn).where((F.col("_rn") == 1) | (F.col(count_col) > 1)).drop("_rn")
