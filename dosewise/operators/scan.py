"""Ordered scans (running sums, row index) without a single-partition window.

A window ``PARTITION BY g ORDER BY x`` puts every row of ``g`` in one task.
For large groups (a whole fold of predictions) the scan is split in two
levels: rows are cut into ordered buckets, per-bucket totals (a small table:
groups x buckets) are prefix-summed, and each bucket is scanned in its own
window partition with the bucket offset added.  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_bucket(df: DataFrame, col: str, out_col: str = "_bkt", buckets: int | None = None) -> DataFrame:
    """Add the ordered bucket of ``col`` between quantiles of its values, so piled-up values spread evenly.

    The number of buckets follows ``spark.sql.shuffle.partitions`` unless given.
    """
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 10000)).scalar()
    cut = df.withColumn("_cuts", cuts)
    return cut.withColumn(out_col, F.size(F.filter("_cuts", lambda c: c < F.col(col)))).drop("_cuts")


def running_sums(df: DataFrame, group_cols, order_col: str, bucket: Column, values, descending: bool = True,
                 index_col: str = "idx", neighbours: bool = False) -> DataFrame:
    """Add ``cum_<v>`` running sums and a 1-based ``index_col`` in ``order_col`` order per group.

    ``order_col`` must be unique within a group and ``bucket`` monotone in it.
    ``neighbours`` adds ``next_<v>`` (the value of the following row, NULL at the
    end) and ``all_<v>`` (the group's total); at a bucket's border both come from
    the table of bucket totals, not from a self-join.
    """
    group_cols = list(group_cols)
    values = list(values)
    b = df.withColumn("_bkt", bucket).withColumn("_one", F.lit(1))
    vals = values + ["_one"]
    first = F.max_by if descending else F.min_by
    tot = b.groupBy(*group_cols, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in vals],
                                             *[first(v, order_col).alias(f"_f_{v}") for v in values if neighbours])
    border = F.col("_bkt").desc() if descending else F.col("_bkt").asc()
    wb = Window.partitionBy(*group_cols).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group_cols, "_bkt", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}")
                                            for v in vals],
                     *[F.lead(f"_f_{v}").over(Window.partitionBy(*group_cols).orderBy(border)).alias(f"_n_{v}")
                       for v in values if neighbours],
                     *[F.sum(f"_t_{v}").over(Window.partitionBy(*group_cols)).alias(f"all_{v}") for v in values if neighbours])
    oorder = F.col(order_col).desc() if descending else F.col(order_col).asc()
    wi = Window.partitionBy(*group_cols, "_bkt").orderBy(oorder).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(off, [*group_cols, "_bkt"], "inner")
    out = out.withColumns({f"cum_{v}": F.col(f"_o_{v}") + F.sum(v).over(wi) for v in values})
    if neighbours:
        ahead = Window.partitionBy(*group_cols, "_bkt").orderBy(oorder)
        out = out.withColumns({f"next_{v}": F.coalesce(F.lead(v).over(ahead), F.col(f"_n_{v}")) for v in values})
    out = out.withColumn(index_col, (F.col("_o__one") + F.sum("_one").over(wi)).cast("long"))
    return out.drop("_bkt", "_one", *[f"_o_{v}" for v in vals], *[f"_n_{v}" for v in values])

