"""Classification metrics, ROC curves, AUC and ROC averaging as Spark jobs.

Predictions are a DataFrame with a label, a hard prediction and/or a
positive-class score, plus any grouping columns (method, run, fold, type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ROC_GRID_POINTS
from .scan import quantile_bucket, running_sums


def _div0(a, b):
    """a / b, 0 when undefined (the convention of the usual metric functions)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(preds: DataFrame, by=(), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y_true).cast("int"), F.col(y_pred).cast("int")
    return preds.groupBy(*by).agg(
        F.sum(F.when((t == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((t == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((t == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
        F.sum(F.when((t == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
    )


def classification_metrics(preds: DataFrame, by=(), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """accuracy, precision, sensitivity, specificity, f1_score (positive = 1) and support (NULL)."""
    c = confusion(preds, by, y_true, y_pred)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        *by,
        _div0(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("sensitivity"),
        _div0(tn, tn + fp).alias("specificity"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        F.lit(None).cast("double").alias("support"),
    )


def roc_points(preds: DataFrame, by=(), y_true: str = "y_true", score: str = "score",
               buckets: int | None = None) -> DataFrame:
    """Full ROC staircase per group, one point per distinct score, plus the (0, 0) start.

    Columns: by..., idx (0 = start), threshold, tps, fps, fpr, tpr, and the step
    to the point (pos, neg), the step to the next one (next_pos, next_neg, NULL
    at the end) and the group's totals (all_pos, all_neg).  Counts per distinct
    score are partial aggregates; running sums use the two-level scan over
    quantile buckets.
    """
    by = list(by)
    if not by:  # one global curve: use a constant key so every step stays an equi-join
        out = roc_points(preds.withColumn("_all", F.lit(0)), ["_all"], y_true, score, buckets)
        return out.drop("_all")
    t = F.col(y_true).cast("int")
    per = preds.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(t).alias("pos"), F.sum(1 - t).alias("neg"))
    cut = quantile_bucket(per, "threshold", "_q", buckets)
    pts = running_sums(cut, by, "threshold", F.col("_q"), ["pos", "neg"], descending=True, neighbours=True)
    # the first point also emits the start
    zero = F.lit(0).cast("long")
    point = F.struct("idx", "threshold", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"), "pos", "neg", "next_pos", "next_neg")
    start = F.struct(zero.alias("idx"), (F.col("threshold") + 1).alias("threshold"), zero.alias("tps"), zero.alias("fps"), zero.alias("pos"),
                     zero.alias("neg"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    pts = pts.select(*by, "all_pos", "all_neg", F.explode(F.when(F.col("idx") == 1, F.array(start, point)).otherwise(F.array(point))).alias("p"))
    return pts.select(*by, "p.idx", "p.threshold", "p.tps", "p.fps",
                      F.try_divide(F.col("p.fps"), F.col("all_neg")).alias("fpr"),
                      F.try_divide(F.col("p.tps"), F.col("all_pos")).alias("tpr"),
                      "p.pos", "p.neg", "p.next_pos", "p.next_neg", "all_pos", "all_neg")


def roc_curve(preds: DataFrame, by=(), y_true: str = "y_true", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """ROC curve points (by..., idx, threshold, fpr, tpr) with collinear interior points removed.

    A point is kept when it starts or ends the score staircase or when the
    second difference of either cumulative count is non-zero; the (0, 0)
    start point is always kept.
    """
    pts = roc_points(preds, by, y_true, score)
    if drop_intermediate:
        bend = (F.col("next_neg") != F.col("neg")) | (F.col("next_pos") != F.col("pos"))
        pts = pts.where((F.col("idx") <= 1) | F.col("next_pos").isNull() | bend)
    return pts.select(*by, "idx", "threshold", "fpr", "tpr")


def auc(points: DataFrame, by=()) -> DataFrame:
    """Trapezoid area under the ``roc_points``; one row per group."""
    fpr_p = F.try_divide(F.col("fps") - F.col("neg"), F.col("all_neg"))
    tpr_p = F.try_divide(F.col("tps") - F.col("pos"), F.col("all_pos"))
    return points.groupBy(*by).agg(F.sum((F.col("fpr") - fpr_p) * (F.col("tpr") + tpr_p) / 2.0).alias("auc"))


def fpr_grid(spark, n: int = ROC_GRID_POINTS) -> DataFrame:
    """Evenly spaced FPR grid on [0, 1] (``j * (1/(n-1))``, last point exactly 1)."""
    step = 1.0 / (n - 1)
    return spark.range(n).select(F.col("id").cast("int").alias("j"), F.when(
        F.col("id") == n - 1, F.lit(1.0)).otherwise(F.col("id") * F.lit(step)).alias("fpr"))


def interpolate_tpr(points: DataFrame, by=(), n: int = ROC_GRID_POINTS) -> DataFrame:
    """Linear interpolation of each curve at the FPR grid (first grid point forced to 0).

    Each curve segment [fpr_i, fpr_i+1) emits only the grid indices it covers
    (a bounded ``sequence``), so there is no grid x curve product.  At repeated
    FPR values the last point wins; beyond the last point its TPR holds.
    """
    by = list(by)
    step = 1.0 / (n - 1)
    seg = points.select(*by, "idx", "fpr", "tpr", F.try_divide(F.col("fps") + F.col("next_neg"), F.col("all_neg")).alias("fpr_n"),
                        F.try_divide(F.col("tps") + F.col("next_pos"), F.col("all_pos")).alias("tpr_n"))
    seg = seg.where(F.col("fpr_n").isNull() | (F.col("fpr_n") > F.col("fpr")))
    j_lo = F.greatest(F.floor(F.col("fpr") * (n - 1)) - 1, F.lit(0)).cast("int")
    j_hi = F.when(F.col("fpr_n").isNull(), F.lit(n - 1)).otherwise(
        F.least(F.ceil(F.col("fpr_n") * (n - 1)) + 1, F.lit(n - 1))).cast("int")
    g = seg.withColumn("j", F.explode(F.sequence(j_lo, j_hi)))
    x = F.when(F.col("j") == n - 1, F.lit(1.0)).otherwise(F.col("j") * F.lit(step))
    g = g.withColumn("x", x).where((F.col("x") >= F.col("fpr")) & (F.col("fpr_n").isNull() | (F.col("x") < F.col("fpr_n"))))
    slope = (F.col("tpr_n") - F.col("tpr")) / (F.col("fpr_n") - F.col("fpr"))
    val = F.when(F.col("fpr_n").isNull() | (F.col("x") == F.col("fpr")), F.col("tpr")).otherwise(
        slope * (F.col("x") - F.col("fpr")) + F.col("tpr"))
    return g.select(*by, "j", F.col("x").alias("fpr"), F.when(F.col("j") == 0, F.lit(0.0)).otherwise(val).alias("tpr"))


def mean_roc(interp: DataFrame, n: int = ROC_GRID_POINTS) -> DataFrame:
    """Mean TPR per grid point over all curves; last point forced to 1."""
    m = interp.groupBy("j", "fpr").agg(F.avg("tpr").alias("tpr_mean"))
    return m.select("j", F.col("fpr").alias("fpr_mean"),
                    F.when(F.col("j") == n - 1, F.lit(1.0)).otherwise(F.col("tpr_mean")).alias("tpr_mean"))


def mean_auc(mean_curve: DataFrame, fold_aucs: DataFrame) -> DataFrame:
    """AUC of the mean curve (100 grid points) and population std of the per-curve AUCs."""
    w = Window.orderBy("j")  # the grid's points
    nb = mean_curve.withColumns({f"{c}_p": F.lag(c).over(w) for c in ("fpr_mean", "tpr_mean")})
    area = (F.col("fpr_mean") - F.col("fpr_mean_p")) * (F.col("tpr_mean") + F.col("tpr_mean_p")) / 2.0
    std = fold_aucs.agg(F.stddev_pop("auc")).scalar()
    return nb.agg(F.sum(area).alias("auc_mean")).select("auc_mean", std.alias("auc_std"))
