"""Column statistics over a feature table: correlation, VIF, histograms, row stats.

All scans are single distributed aggregates; only results bounded by the
number of columns (a p x p Gram matrix at most) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gram import co_moments
from .reshape import _q


def pearson(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair: (col_a, col_b, r).

    One pass of co-moments around the columns' means; a column that is constant
    over a pair's rows gives NULL.
    """
    cols = list(cols)
    means = df.agg(*[F.avg(F.col(_q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    sums = co_moments(df, cols, [m or 0.0 for m in means]).where("n > 0")
    other = sums.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    both = sums.join(other, ["i", "j"])  # a row per pair of columns

    def spread(total, squares):
        """Centred squares; what is left of a constant by rounding is none."""
        left = F.col(squares) - F.col(total) * F.col(total) / F.col("n")
        return F.when((F.col("n") > 1) & (left > F.col(squares) * 1e-13), left)

    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    names = F.array(*[F.lit(c) for c in cols])
    found = both.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), r.alias("r"))
    pairs = df.sparkSession.createDataFrame([(a, b) for a in cols for b in cols], "col_a string, col_b string")
    return pairs.join(found, ["col_a", "col_b"], "left")  # columns that never meet have no r


def gram(df: DataFrame, cols):
    """(n, sums, G = X'X) over rows with no NULL in ``cols``; one pass, p x p numbers to the driver."""
    cols = list(cols)
    p = len(cols)
    got = co_moments(df, cols, complete=True).toPandas()
    g, sums, n = np.zeros((p, p)), np.zeros(p), 0
    for r in got.itertuples():
        g[r.i, r.j] = r.xy
        if r.i == r.j:
            sums[r.i], n = r.x, int(r.n)
    return n, sums, g


def vif_from_gram(n, sums, g) -> list:
    """VIF of each column regressed on all others without intercept.

    R^2 is uncentered unless a constant lies in the span of the other columns
    (then centered), as an OLS fit without an explicit intercept reports it.
    """
    p = g.shape[0]
    out = []
    for i in range(p):
        others = [j for j in range(p) if j != i]
        gi = g[np.ix_(others, others)]
        xy = g[others, i]
        beta = np.linalg.pinv(gi) @ xy
        rss = g[i, i] - xy @ beta
        aug = np.zeros((p, p))
        aug[0, 0] = n
        aug[0, 1:] = sums[others]
        aug[1:, 0] = sums[others]
        aug[1:, 1:] = gi
        has_const = np.linalg.matrix_rank(gi) == np.linalg.matrix_rank(aug)
        tss = g[i, i] - (sums[i] ** 2 / n if has_const else 0.0)
        out.append(float("inf") if rss <= 0 else float(tss / rss))
    return out


def vif(df: DataFrame, cols) -> DataFrame:
    """(feature, vif) for every column; one distributed Gram-matrix aggregate."""
    cols = list(cols)
    n, sums, g = gram(df, cols)
    vals = vif_from_gram(n, sums, g)
    return df.sparkSession.createDataFrame([(c, v) for c, v in zip(cols, vals)], "feature string, vif double")


def correlated_to_drop(df: DataFrame, cols, threshold: float = 0.85) -> list:
    """Later column of every pair with signed r > threshold (upper triangle)."""
    cols = list(cols)
    pos = {c: i for i, c in enumerate(cols)}
    rows = pearson(df, cols).where(F.col("r") > threshold).collect()  # at most p*p rows
    return sorted({r["col_b"] for r in rows if pos[r["col_a"]] < pos[r["col_b"]]}, key=pos.get)


def drop_correlated(df: DataFrame, cols, threshold: float = 0.85) -> DataFrame:
    return df.drop(*correlated_to_drop(df, cols, threshold))


def histogram(df: DataFrame, cols, bins: int = 10) -> DataFrame:
    """Fixed-width histogram of every column: (column, bin, lo, hi, count), empty bins included.

    Range is [min, max] per column (min-0.5, max+0.5 when constant); the last
    bin is closed.
    """
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    arr = "array(" + ", ".join(f"CAST({_q(c)} AS DOUBLE)" for c in cols) + ")"
    long = df.selectExpr(f"posexplode({arr}) AS (pos, v)").where(F.col("v").isNotNull())
    rng = long.groupBy("pos").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    rng = rng.select("pos",
                     F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    # one row per column: broadcast is bounded by the column count
    b = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                F.lit(bins - 1)).cast("int")
    counts = long.join(F.broadcast(rng), "pos").groupBy("pos", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("pos", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(counts, ["pos", "bin"], "left").select(
        F.element_at(names, F.col("pos") + 1).alias("column"), "bin",
        (F.col("lo") + F.col("bin") * w).alias("bin_lo"), (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def row_stats(df: DataFrame, cols, prefix: str) -> DataFrame:
    """Row-wise mean and sample std across ``cols`` (NULLs skipped; n<2 -> NULL std).

    Plain arithmetic over the listed columns, so it stays inside whole-stage codegen.
    """
    xs = [F.col(_q(c)).cast("double") for c in cols]
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    total = F.lit(0.0)
    for x in xs:
        total = total + F.coalesce(x, F.lit(0.0))
    mean = F.when(n > 0, total / n)
    ss = F.lit(0.0)
    for x in xs:
        ss = ss + F.coalesce((x - mean) * (x - mean), F.lit(0.0))
    return df.withColumns({prefix + "mean": mean, prefix + "std": F.when(n > 1, F.sqrt(ss / (n - 1)))})


def mean_days_between(df: DataFrame, group_cols, date_col: str) -> DataFrame:
    """Mean whole-day gap between sorted dates per group; fewer than two dates -> NULL."""
    w = Window.partitionBy(*group_cols).orderBy(date_col)
    d = F.col(date_col).cast("timestamp_ntz")
    gaps = df.where(F.col(date_col).isNotNull()).withColumn(
        "_gap", F.floor(F.timestamp_diff("SECOND", F.lag(d).over(w), d) / 86400))
    return gaps.groupBy(*group_cols).agg(F.avg("_gap").alias("mean_days_between"))
