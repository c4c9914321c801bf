"""Fold assignment, sampling and evaluation queries.

Evaluation runs on a fixed score derived from ``events`` (no model needed):
score = value / (1 + value), label = purchase event, hard prediction =
score >= 0.9, curve group = a seeded hash fold of the user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluation import (auc, classification_metrics, interpolate_tpr, mean_auc, mean_roc, roc_curve,
                                    roc_points)
from ..operators.folds import group_folds, seeded_hash, seeded_sample
from ..operators.horizons import add_target, daily_features
from . import oracle as O
from .cohort import analysis_events
from .registry import SPEC, events, r6, register

N_FOLDS = 5


def predictions(spark, sf_dir):
    ev = events(spark, sf_dir)
    score = F.col("value") / (1 + F.col("value"))
    return ev.select(
        "user_id", "event_id",
        (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        score.alias("score"),
        (score >= 0.9).cast("int").alias("y_pred"),
        (seeded_hash(0, "user_id") % N_FOLDS).cast("int").alias("fold"),
    )


_PREDS = f"""
preds AS (
  SELECT user_id, event_id, CAST(event_type = 'purchase' AS INTEGER) AS y_true, value / (1 + value) AS score,
         CAST(value / (1 + value) >= 0.9 AS INTEGER) AS y_pred,
         CAST({O.md5_int("'0|' || CAST(user_id AS VARCHAR)")} % {N_FOLDS} AS INTEGER) AS fold
  FROM events
),
cm AS (
  SELECT fold, SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn,
         SUM(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn
  FROM preds GROUP BY fold
),
per AS (SELECT fold, score AS threshold, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM preds GROUP BY fold, score),
pts AS (
  SELECT fold, threshold, row_number() OVER w AS idx,
         SUM(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tps, SUM(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fps
  FROM per WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)
),
tot AS (SELECT fold, SUM(pos) AS P, SUM(neg) AS N, MAX(threshold) + 1 AS thr0 FROM per GROUP BY fold),
allp AS (SELECT fold, idx, threshold, tps, fps FROM pts UNION ALL SELECT fold, 0, thr0, 0, 0 FROM tot),
curve AS (
  SELECT a.fold, a.idx, a.threshold, CAST(a.tps AS BIGINT) AS tps, CAST(a.fps AS BIGINT) AS fps,
         a.fps / NULLIF(t.N, 0) AS fpr, a.tps / NULLIF(t.P, 0) AS tpr
  FROM allp a JOIN tot t ON t.fold = a.fold
),
fauc AS (
  SELECT fold, SUM((fpr - fpr_p) * (tpr + tpr_p) / 2.0) AS auc FROM (
    SELECT fold, fpr, tpr, LAG(fpr) OVER w AS fpr_p, LAG(tpr) OVER w AS tpr_p FROM curve
    WINDOW w AS (PARTITION BY fold ORDER BY idx)) x GROUP BY fold
),
seg AS (
  SELECT fold, idx, fpr, tpr, LEAD(fpr) OVER w AS fpr_n, LEAD(tpr) OVER w AS tpr_n FROM curve
  WINDOW w AS (PARTITION BY fold ORDER BY idx)
),
grid AS (
  SELECT CAST(j AS INTEGER) AS j,
         CASE WHEN j = 99 THEN CAST(1 AS DOUBLE) ELSE j * (CAST(1 AS DOUBLE) / 99) END AS x
  FROM range(100) t(j)
),
iv AS (
  SELECT s.fold, g.j, g.x,
         CASE WHEN g.j = 0 THEN CAST(0 AS DOUBLE)
              WHEN s.fpr_n IS NULL OR g.x = s.fpr THEN s.tpr
              ELSE (s.tpr_n - s.tpr) / (s.fpr_n - s.fpr) * (g.x - s.fpr) + s.tpr END AS tpr
  FROM seg s JOIN grid g ON g.x >= s.fpr AND (s.fpr_n IS NULL OR g.x < s.fpr_n)
  WHERE s.fpr_n IS NULL OR s.fpr_n > s.fpr
),
mr AS (
  SELECT j, x AS fpr_mean, CASE WHEN j = 99 THEN CAST(1 AS DOUBLE) ELSE AVG(tpr) END AS tpr_mean FROM iv GROUP BY j, x
)"""


def _metric_sql(by: str) -> str:
    def d(a, b):
        return f"ROUND(COALESCE(CAST({a} AS DOUBLE) / NULLIF({b}, 0), 0), 6) + 0.0"
    return f"""SELECT {by}, {d('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {d('tp', 'tp + fp')} AS precision,
  {d('tp', 'tp + fn')} AS sensitivity, {d('tn', 'tn + fp')} AS specificity,
  {d('2 * tp', '2 * tp + fp + fn')} AS f1_score, CAST(NULL AS DOUBLE) AS support FROM cm"""


def _r6_all(df, cols):
    return df.withColumns({c: r6(c) for c in cols})


@register("classification_metrics", O.with_cohort(_metric_sql("fold"), _PREDS))
def q_class_metrics(spark, sf_dir):
    m = classification_metrics(predictions(spark, sf_dir), ["fold"])
    return _r6_all(m, ["accuracy", "precision", "sensitivity", "specificity", "f1_score"])


@register("overfit_metrics", O.with_cohort(_metric_sql("type"), _PREDS.replace(
    "FROM preds GROUP BY fold\n),\nper", "FROM (SELECT *, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS type "
    "FROM preds) p GROUP BY type\n),\nper").replace("SELECT fold, SUM(CASE WHEN y_true = 1 AND y_pred = 1",
                                                    "SELECT type, SUM(CASE WHEN y_true = 1 AND y_pred = 1")))
def q_overfit(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("type", F.when(F.col("fold") == 0, "test").otherwise("train"))
    m = classification_metrics(p, ["type"])
    return _r6_all(m, ["accuracy", "precision", "sensitivity", "specificity", "f1_score"])


@register("roc_curve", O.with_cohort("""
SELECT fold, idx, ROUND(threshold, 6) + 0.0 AS threshold, ROUND(fpr, 6) + 0.0 AS fpr, ROUND(tpr, 6) + 0.0 AS tpr FROM (
  SELECT *, LAG(tps) OVER w AS tps_p, LAG(fps) OVER w AS fps_p, LEAD(tps) OVER w AS tps_n, LEAD(fps) OVER w AS fps_n
  FROM curve WINDOW w AS (PARTITION BY fold ORDER BY idx)) nb
WHERE idx <= 1 OR tps_n IS NULL OR (fps_n - 2 * fps + fps_p) <> 0 OR (tps_n - 2 * tps + tps_p) <> 0""", _PREDS))
def q_roc_curve(spark, sf_dir):
    c = roc_curve(predictions(spark, sf_dir), ["fold"])
    return _r6_all(c, ["threshold", "fpr", "tpr"])


@register("auc", O.with_cohort("SELECT fold, ROUND(auc, 6) + 0.0 AS auc FROM fauc", _PREDS))
def q_auc(spark, sf_dir):
    return _r6_all(auc(roc_points(predictions(spark, sf_dir), ["fold"]), ["fold"]), ["auc"])


@register("pooled_auc", O.with_cohort("""
SELECT ROUND(SUM((fpr - fpr_p) * (tpr + tpr_p) / 2.0), 6) + 0.0 AS auc FROM (
  SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY idx) AS fpr_p, LAG(tpr) OVER (ORDER BY idx) AS tpr_p FROM (
    SELECT idx, fps / NULLIF(SUM(neg) OVER (), 0) AS fpr, tps / NULLIF(SUM(pos) OVER (), 0) AS tpr FROM (
      SELECT threshold, pos, neg, row_number() OVER w AS idx, SUM(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tps,
             SUM(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fps
      FROM (SELECT score AS threshold, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM preds GROUP BY score) s
      WINDOW w AS (ORDER BY threshold DESC)) c
    UNION ALL SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)) z) y""", _PREDS))
def q_pooled_auc(spark, sf_dir):
    """AUC over all folds' predictions concatenated."""
    return _r6_all(auc(roc_points(predictions(spark, sf_dir))), ["auc"])


@register("roc_interp", O.with_cohort(
    "SELECT fold, j, ROUND(x, 6) + 0.0 AS fpr, ROUND(tpr, 6) + 0.0 AS tpr FROM iv", _PREDS))
def q_roc_interp(spark, sf_dir):
    it = interpolate_tpr(roc_points(predictions(spark, sf_dir), ["fold"]), ["fold"])
    return _r6_all(it, ["fpr", "tpr"])


@register("mean_roc", O.with_cohort(
    "SELECT j, ROUND(fpr_mean, 6) + 0.0 AS fpr_mean, ROUND(tpr_mean, 6) + 0.0 AS tpr_mean FROM mr", _PREDS))
def q_mean_roc(spark, sf_dir):
    m = mean_roc(interpolate_tpr(roc_points(predictions(spark, sf_dir), ["fold"]), ["fold"]))
    return _r6_all(m, ["fpr_mean", "tpr_mean"])


@register("mean_auc", O.with_cohort("""
SELECT ROUND((SELECT SUM((fpr_mean - fpr_p) * (tpr_mean + tpr_p) / 2.0) FROM (
          SELECT fpr_mean, tpr_mean, LAG(fpr_mean) OVER (ORDER BY j) AS fpr_p, LAG(tpr_mean) OVER (ORDER BY j) AS tpr_p
          FROM mr) x), 6) + 0.0 AS auc_mean,
       ROUND((SELECT stddev_pop(auc) FROM fauc), 6) + 0.0 AS auc_std""", _PREDS))
def q_mean_auc(spark, sf_dir):
    pts = roc_points(predictions(spark, sf_dir), ["fold"])
    m = mean_auc(mean_roc(interpolate_tpr(pts, ["fold"])), auc(pts, ["fold"]))
    return _r6_all(m, ["auc_mean", "auc_std"])


# ---------------------------------------------------------------- folds and sampling
_DAYT = f"""
dt AS (
  SELECT user_id, study_day, CAST(MAX(withinrange) > 0.8 AS INTEGER) AS adherent, CAST(SUM(numtimes) AS BIGINT) AS n_events
  FROM ded GROUP BY user_id, study_day
),
cc AS (
  SELECT user_id, COUNT(*) AS n_rows, CAST(SUM(CAST(adherent = 1 AS INTEGER)) AS BIGINT) AS n_pos FROM dt GROUP BY user_id
)"""


def _day_table(spark, sf_dir):
    return add_target(daily_features(analysis_events(events(spark, sf_dir), SPEC)))


@register("group_folds", O.with_cohort(f"""
SELECT user_id, n_rows, n_pos, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY h, user_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT *, CAST(n_pos * 10 // n_rows AS INTEGER) AS stratum,
             {O.md5_int("'7|' || CAST(user_id AS VARCHAR)")} AS h FROM cc) s""", _DAYT))
def q_group_folds(spark, sf_dir):
    return group_folds(_day_table(spark, sf_dir), "user_id", "adherent", k=5, seed=7)


@register("seeded_sample", O.with_cohort("""
SELECT user_id, study_day, adherent, n_events FROM dt
ORDER BY md5('3|' || CAST(user_id AS VARCHAR) || '|' || CAST(study_day AS VARCHAR)), user_id, study_day
LIMIT 1000""", _DAYT))
def q_seeded_sample(spark, sf_dir):
    df = _day_table(spark, sf_dir).select("user_id", "study_day", "adherent", "n_events")
    return seeded_sample(df, 1000, 3, ["user_id", "study_day"])
