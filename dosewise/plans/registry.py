"""Query registry shared by the per-area query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CohortSpec
from ..session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPEC = CohortSpec()


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def r6(c):
    """Round to 6 places; ``+ 0.0`` folds -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def portable(df: DataFrame, doubles=(), dates=()) -> DataFrame:
    """Engine-neutral output types: nullable integers as DOUBLE, dates as ISO text."""
    return df.withColumns({**{c: F.col(c).cast("double") for c in doubles},
                           **{c: F.date_format(c, "yyyy-MM-dd") for c in dates}})
