"""Result-table queries: repeated-run metric summaries, ranking, labels, attributions.

Metric rows come from the fixed event score (see ``q_eval``) evaluated over
5 seeded runs; in each run a seeded hash assigns users to 5 folds and fold 0
is the test side.  All runs are one exploded pass (runs x rows), not a loop.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.attribution import fitted_linear_attribution, linear_attribution, sampled_attribution
from ..operators.evaluation import auc, classification_metrics, interpolate_tpr, mean_auc, mean_roc, roc_points
from ..operators.folds import seeded_hash, seeded_sample
from ..operators.modeling import fit
from ..operators.tree_attribution import leaf_paths, model_trees, tree_attribution
from ..operators.results import (condense, featureset_title, legend_label, prettify, rank_final, read_results, summarize,
                                 top_features, write_results, with_final_auc)
from ..session import cut_lineage, ensure_checkpoint_dir
from . import oracle as O
from .q_eval import predictions
from .q_model import _final_split, _weekly
from .q_tables import _WF_SQL
from .registry import SPEC, r6, register

RUNS = 5
_CFG = {"featureset": "events_score", "method": "threshold", "features_selected": False, "tuned": False}


def run_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    fold = seeded_hash(F.col("run"), "user_id") % 5
    return p.withColumn("type", F.when(fold == 0, "test").otherwise("train"))


def _with_cfg(df):
    return df.select(*[F.lit(v).alias(k) for k, v in _CFG.items()], "*")


def pred_rows(spark, sf_dir):
    return _with_cfg(classification_metrics(run_predictions(spark, sf_dir), ["run", "type"]))


def auc_rows(spark, sf_dir):
    test = run_predictions(spark, sf_dir).where(F.col("type") == "test")
    pts = roc_points(test, ["run"])
    m = mean_auc(mean_roc(interpolate_tpr(pts, ["run"])), auc(pts, ["run"]))
    return _with_cfg(m.withColumn("type", F.lit("test")))


_RUN_SQL = """
rp AS (
  SELECT p.*, r.run,
         CASE WHEN ('0x' || substr(md5(CAST(r.run AS VARCHAR) || '|' || CAST(p.user_id AS VARCHAR)), 1, 8))::BIGINT % 5 = 0
              THEN 'test' ELSE 'train' END AS type
  FROM preds p CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS run) r
),
rcm AS (
  SELECT run, type, SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn,
         SUM(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn
  FROM rp GROUP BY run, type
),
prow AS (
  SELECT run, type,
    COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(tp + fp + tn + fn, 0), 0) AS accuracy,
    COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision,
    COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS sensitivity,
    COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0) AS specificity,
    COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1_score
  FROM rcm
),
rper AS (SELECT run, score AS threshold, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM rp WHERE type = 'test'
         GROUP BY run, score),
rcur AS (
  SELECT run, idx, fps / NULLIF(SUM(neg) OVER (PARTITION BY run), 0) AS fpr,
         tps / NULLIF(SUM(pos) OVER (PARTITION BY run), 0) AS tpr
  FROM (SELECT run, threshold, pos, neg, row_number() OVER w AS idx, SUM(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tps,
               SUM(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fps
        FROM rper WINDOW w AS (PARTITION BY run ORDER BY threshold DESC)) c
  UNION ALL SELECT run, 0, 0, 0 FROM (SELECT DISTINCT run FROM rper) z
),
rauc AS (
  SELECT run, SUM((fpr - fpr_p) * (tpr + tpr_p) / 2.0) AS auc FROM (
    SELECT run, fpr, tpr, LAG(fpr) OVER w AS fpr_p, LAG(tpr) OVER w AS tpr_p FROM rcur
    WINDOW w AS (PARTITION BY run ORDER BY idx)) x GROUP BY run
),
rseg AS (
  SELECT run, fpr, tpr, LEAD(fpr) OVER w AS fpr_n, LEAD(tpr) OVER w AS tpr_n FROM rcur WINDOW w AS (PARTITION BY run ORDER BY idx)
),
riv AS (
  SELECT s.run, g.j, g.x, CASE WHEN g.j = 0 THEN CAST(0 AS DOUBLE) WHEN s.fpr_n IS NULL OR g.x = s.fpr THEN s.tpr
              ELSE (s.tpr_n - s.tpr) / (s.fpr_n - s.fpr) * (g.x - s.fpr) + s.tpr END AS tpr
  FROM rseg s JOIN grid g ON g.x >= s.fpr AND (s.fpr_n IS NULL OR g.x < s.fpr_n) WHERE s.fpr_n IS NULL OR s.fpr_n > s.fpr
),
rmean AS (SELECT j, x, CASE WHEN j = 99 THEN CAST(1 AS DOUBLE) ELSE AVG(tpr) END AS tpr FROM riv GROUP BY j, x),
rarea AS (
  SELECT SUM((x - x_p) * (tpr + tpr_p) / 2.0) AS auc_mean FROM (
    SELECT x, tpr, LAG(x) OVER (ORDER BY j) AS x_p, LAG(tpr) OVER (ORDER BY j) AS tpr_p FROM rmean) y
),
summ AS (
  SELECT s.type, {aggs}, COALESCE(a.auc_mean, -1) AS auc_mean, COALESCE(a.auc_std, -1) AS auc_std
  FROM prow s FULL OUTER JOIN (SELECT 'test' AS type, (SELECT auc_mean FROM rarea) AS auc_mean, stddev_pop(auc) AS auc_std FROM rauc) a
    ON a.type = s.type
  GROUP BY s.type, a.auc_mean, a.auc_std
)""".format(aggs=", ".join(
    f"AVG({m}{' * 100' if m != 'f1_score' else ''}) AS {m}_mean, "
    f"stddev_samp({m}{' * 100' if m != 'f1_score' else ''}) AS {m}_std, "
    f"var_samp({m}{' * 100' if m != 'f1_score' else ''}) AS {m}_var"
    for m in ("accuracy", "precision", "sensitivity", "specificity", "f1_score")))

def _preds_sql():
    from .q_eval import _PREDS
    return _PREDS


_SUM_COLS = [f"{m}_{s}" for m in ("accuracy", "precision", "sensitivity", "specificity", "f1_score")
             for s in ("mean", "std", "var")] + ["auc_mean", "auc_std"]


@register("results_summary", O.with_cohort(
    "SELECT 'events_score' AS featureset, 'threshold' AS method, false AS features_selected, false AS tuned, type, "
    + ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in _SUM_COLS) + " FROM summ",
    _preds_sql() + "," + _RUN_SQL))
def q_results_summary(spark, sf_dir):
    s = summarize(pred_rows(spark, sf_dir), auc_rows(spark, sf_dir))
    return s.withColumns({c: r6(c) for c in _SUM_COLS})


_COND = ("accuracy", "precision", "sensitivity", "specificity", "f1_score", "auc")


@register("results_condensed", O.with_cohort(
    "SELECT 'events_score' AS featureset, 'threshold' AS method, false AS features_selected, false AS tuned, type, "
    + ", ".join(f"printf('%.3f $\\pm$ %.3f', ROUND({m}_mean, 9), ROUND({m}_std, 9)) AS {m}" for m in _COND)
    + " FROM summ", _preds_sql() + "," + _RUN_SQL))
def q_results_condensed(spark, sf_dir):
    s = summarize(pred_rows(spark, sf_dir), auc_rows(spark, sf_dir))
    s = s.withColumns({c: F.round(c, 9) for c in _SUM_COLS})
    return condense(s)


@register("final_ranking", O.with_cohort(f"""
SELECT 'events_score' AS featureset, 'threshold' AS method, m.type, ROUND(m.specificity, 6) + 0.0 AS specificity,
       ROUND(a.auc, 6) + 0.0 AS auc,
       printf('%s (AUC = %.3f)', 'threshold', ROUND(a.auc, 9)) AS legend_label,
       'Next- Prediction w/MEMS-Only Feature Set' AS title, 'Events score' AS pretty_featureset
FROM (SELECT 'test' AS type, COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0) AS specificity FROM fcm) m
CROSS JOIN (SELECT SUM((fpr - fpr_p) * (tpr + tpr_p) / 2.0) AS auc FROM (
    SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY idx) AS fpr_p, LAG(tpr) OVER (ORDER BY idx) AS tpr_p FROM fcur) x) a""",
    _preds_sql() + """,
fp2 AS (SELECT * FROM preds WHERE ('0x' || substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 2 = 0),
fcm AS (SELECT SUM(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp,
               SUM(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn FROM fp2),
fper AS (SELECT score AS threshold, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM fp2 GROUP BY score),
fcur AS (
  SELECT idx, fps / NULLIF(SUM(neg) OVER (), 0) AS fpr, tps / NULLIF(SUM(pos) OVER (), 0) AS tpr FROM (
    SELECT threshold, pos, neg, row_number() OVER w AS idx, SUM(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tps,
           SUM(neg) OVER (w ROWS UNBOUNDED PRECEDING) AS fps FROM fper WINDOW w AS (ORDER BY threshold DESC)) c
  UNION ALL SELECT 0, 0, 0
)"""))
def q_final_ranking(spark, sf_dir):
    """Final-split test metrics with AUC, ranked, labelled for display."""
    p = predictions(spark, sf_dir).where(seeded_hash(42, "user_id") % 2 == 0)
    m = _with_cfg(classification_metrics(p.withColumn("type", F.lit("test")), ["type"]))
    a = _with_cfg(auc(roc_points(p)).withColumn("type", F.lit("test")))
    ranked = rank_final(with_final_auc(m, a))
    ranked = ranked.withColumn("_auc9", F.round("auc", 9))
    return ranked.select("featureset", "method", "type", r6("specificity").alias("specificity"),
                         r6("auc").alias("auc"), legend_label("method", "_auc9").alias("legend_label"),
                         featureset_title("featureset").alias("title"),
                         prettify(F.regexp_replace("featureset", "_", " ")).alias("pretty_featureset"))


_ATTR_FEATS = ["n_events", "event_time_mean", "event_time_std", "between_event_time_std"]


def _attr_input(spark, sf_dir):
    wk = _weekly(spark, sf_dir).select("user_id", "study_week", *_ATTR_FEATS)
    sd = wk.agg(*[F.stddev_samp(f).alias(f) for f in _ATTR_FEATS]).first()
    coefs = {f: (1.0 / sd[f] if sd[f] else 0.0) for f in _ATTR_FEATS}
    bg = seeded_sample(wk, 1000, 11, ["user_id", "study_week"])
    return wk, coefs, bg


_ATTR_SQL = _WF_SQL + """,
bgs AS (SELECT * FROM wf ORDER BY md5('11|' || CAST(user_id AS VARCHAR) || '|' || CAST(study_week AS VARCHAR)),
        user_id, study_week LIMIT 1000),
bm AS (SELECT {means} FROM bgs),
sd AS (SELECT {sds} FROM wf),
la AS ({union})""".format(
    means=", ".join(f"AVG(CAST({f} AS DOUBLE)) AS m_{f}" for f in _ATTR_FEATS),
    sds=", ".join(f"stddev_samp({f}) AS s_{f}" for f in _ATTR_FEATS),
    union=" UNION ALL ".join(
        f"SELECT user_id, study_week, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
        f"COALESCE(1.0 / NULLIF(s_{f}, 0), 0) * (CAST({f} AS DOUBLE) - m_{f}) AS shap FROM wf, bm, sd"
        for f in _ATTR_FEATS))


@register("linear_attribution", O.with_cohort(
    "SELECT user_id, study_week, feature, value, ROUND(shap, 6) + 0.0 AS shap FROM la", _ATTR_SQL))
def q_linear_attribution(spark, sf_dir):
    wk, coefs, bg = _attr_input(spark, sf_dir)
    return linear_attribution(wk, ["user_id", "study_week"], coefs, bg).withColumn("shap", r6("shap"))


@register("top_features", O.with_cohort("""
SELECT feature, ROUND(AVG(ABS(shap)), 6) + 0.0 AS mean_abs_shap FROM la GROUP BY feature
ORDER BY mean_abs_shap DESC, feature LIMIT 20""", _ATTR_SQL))
def q_top_features(spark, sf_dir):
    wk, coefs, bg = _attr_input(spark, sf_dir)
    return top_features(linear_attribution(wk, ["user_id", "study_week"], coefs, bg)) \
        .withColumn("mean_abs_shap", r6("mean_abs_shap"))


@register("linear_attribution_lr")
def q_linear_attribution_lr(spark, sf_dir):
    """Attributions of the fitted logistic regression on the whole final test side, as mean |attribution| per feature."""
    tr, te, feats, fs = _final_split(spark, sf_dir)
    model = fit(tr, feats, fs.target_col, "LogisticR", {"C": 1.0}, 42)
    return top_features(fitted_linear_attribution(model, te, [fs.id_col], tr), n=len(feats))


@register("sampled_attribution")
def q_sampled_attribution(spark, sf_dir):
    """Permutation-sampled Shapley values of the depth-2 forest on the final test split (<= 1000 rows,
    background <= 1000 training rows), summarised as mean |attribution| per feature."""
    tr, te, feats, fs = _final_split(spark, sf_dir)
    model = fit(tr, feats, fs.target_col, "RF", {"n_estimators": 100, "max_depth": 2}, 42)
    attr = sampled_attribution(model, te, [fs.id_col] + feats, feats, tr, n_samples=32, seed=42)
    return top_features(attr, n=len(feats))


@register("sampled_attribution_svm")
def q_sampled_attribution_svm(spark, sf_dir):
    """Sampled Shapley values of the RBF SVM on the final test split (<= 100 rows, background <= 100 training rows): batches of 8
    orders until the standard error of every value is at most 0.02, 16 orders at most; mean |attribution| per feature."""
    tr, te, feats, fs = _final_split(spark, sf_dir)
    model = fit(tr, feats, fs.target_col, "SVM", {"C": 1.0}, 42)
    attr = sampled_attribution(model, te, [fs.id_col] + feats, feats, tr, n_samples=8, seed=42, max_rows=100, max_error=0.02, max_samples=16)
    return top_features(attr, n=len(feats))


def _two_methods(summary_sql):
    """The two methods' rows, as ``results_io`` reads them back."""
    return f"{summary_sql.format(method='threshold', src='prow')} UNION ALL {summary_sql.format(method='threshold_flipped', src='xrow')}"


_METRIC_COLS = [f"{m}_{s}" for m in ("accuracy", "precision", "sensitivity", "specificity", "f1_score") for s in ("mean", "std", "var")]


def _result_store(spark, sf_dir):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/dosewise-results/{sf_dir.rstrip('/').split('/')[-1]}"


def _stated_trees(means):
    """Two trees over the weekly features, cut at their means: (nodes, weight) with nodes (feature, threshold, left, right, value)."""
    n, mean, sd, gap = (means[f] for f in _ATTR_FEATS)
    one = {0: (0, n, 1, 2, 0.0), 1: (-1, 0.0, -1, -1, 0.2), 2: (1, mean, 3, 4, 0.0), 3: (-1, 0.0, -1, -1, 0.5), 4: (-1, 0.0, -1, -1, 0.9)}
    two = {0: (2, sd, 1, 2, 0.0), 1: (3, gap, 3, 4, 0.0), 2: (0, n, 5, 6, 0.0),
           3: (-1, 0.0, -1, -1, 0.1), 4: (-1, 0.0, -1, -1, 0.4), 5: (-1, 0.0, -1, -1, 0.6), 6: (-1, 0.0, -1, -1, 0.8)}
    return [(one, 0.5), (two, 0.5)]


# all coalitions of the four features, for the 16 x 16 patterns of being above the means; rows and background only count patterns
_TREE_SQL = _WF_SQL + """,
w0 AS (SELECT user_id, study_week, {zero} FROM wf),
bg0 AS (SELECT * FROM w0 ORDER BY md5('11|' || CAST(user_id AS VARCHAR) || '|' || CAST(study_week AS VARCHAR)), user_id, study_week LIMIT 1000),
mean0 AS (SELECT {means} FROM w0),
xs AS (SELECT user_id, study_week, {bits} AS x FROM w0, mean0),
zs AS (SELECT z, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM (SELECT {bits} AS z FROM bg0, mean0) q GROUP BY z),
pat AS (SELECT CAST(range AS INTEGER) AS v FROM range(16)),
score AS (SELECT v, 0.5 * (CASE WHEN v & 1 = 0 THEN 0.2 WHEN v & 2 = 0 THEN 0.5 ELSE 0.9 END)
  + 0.5 * (CASE WHEN v & 4 = 0 THEN (CASE WHEN v & 8 = 0 THEN 0.1 ELSE 0.4 END) WHEN v & 1 = 0 THEN 0.6 ELSE 0.8 END) AS y FROM pat),
part AS (
  SELECT x.v AS x, z.v AS z, j.range AS j, s.v AS s, (CASE bit_count(s.v) WHEN 0 THEN 6.0 WHEN 1 THEN 2.0 WHEN 2 THEN 2.0 ELSE 6.0 END) / 24 AS w
  FROM pat x, pat z, pat s, range(4) j WHERE (s.v >> CAST(j.range AS INTEGER)) & 1 = 0),
phi AS (
  SELECT x, z, j, SUM(w * (b.y - a.y)) AS phi FROM part
  JOIN score a ON a.v = ((x & s) | (z & (15 - s)))
  JOIN score b ON b.v = ((x & (s | CAST(1 << j AS INTEGER))) | (z & (15 - (s | CAST(1 << j AS INTEGER))))) GROUP BY 1, 2, 3),
of_x AS (SELECT x, j, SUM(phi * share) AS shap FROM phi JOIN zs USING (z) GROUP BY 1, 2)""".format(
    zero=", ".join(f"COALESCE(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in _ATTR_FEATS),
    means=", ".join(f"ROUND(AVG({f}), 4) + 0.00005 AS m{i}" for i, f in enumerate(_ATTR_FEATS)),
    bits=" + ".join(f"(CASE WHEN {f} > m{i} THEN {1 << i} ELSE 0 END)" for i, f in enumerate(_ATTR_FEATS)))


@register("tree_attribution", O.with_cohort(
    "SELECT user_id, study_week, list_element([{names}], CAST(j + 1 AS INTEGER)) AS feature, ROUND(shap, 6) + 0.0 AS shap FROM xs JOIN of_x USING (x)".format(
        names=", ".join(f"'{f}'" for f in _ATTR_FEATS)), _TREE_SQL))
def q_tree_attribution(spark, sf_dir):
    """Exact Shapley values of two stated trees for every week, against a background of 1000 weeks."""
    wk = _weekly(spark, sf_dir).select("user_id", "study_week", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in _ATTR_FEATS])
    row = wk.agg(*[(F.round(F.avg(f), 4) + 0.00005).alias(f) for f in _ATTR_FEATS]).first()
    paths = leaf_paths(spark, _stated_trees({f: row[f] for f in _ATTR_FEATS}))
    got = tree_attribution(paths, wk, ["user_id", "study_week"], _ATTR_FEATS, seeded_sample(wk, 1000, 11, ["user_id", "study_week"]))
    return got.withColumn("shap", r6("shap"))


@register("tree_attribution_rf")
def q_tree_attribution_rf(spark, sf_dir):
    """Exact Shapley values of the depth-2 forest on the whole final test side against the whole training side, as mean |attribution| per feature."""
    tr, te, feats, fs = _final_split(spark, sf_dir)
    paths = leaf_paths(spark, model_trees(spark, fit(tr, feats, fs.target_col, "RF", {"n_estimators": 100, "max_depth": 2}, 42)))
    rows = te.withColumn("_rid", F.monotonically_increasing_id())
    return top_features(tree_attribution(paths, cut_lineage(rows), ["_rid"], feats, tr), n=len(feats))


@register("results_io", O.with_cohort(_two_methods(
    "SELECT 'events_score' AS featureset, '{method}' AS method, false AS features_selected, false AS tuned, type, "
    + ", ".join(f"ROUND({'AVG' if s == 'mean' else 'stddev_samp' if s == 'std' else 'var_samp'}({m}{' * 100' if m != 'f1_score' else ''}), 6) + 0.0 AS {m}_{s}"
                for m, s in (c.rsplit("_", 1) for c in _METRIC_COLS)) + " FROM {src} GROUP BY type"),
    _preds_sql() + "," + _RUN_SQL + """,
xrow AS (
  SELECT run, type,
    COALESCE(CAST(fn + fp AS DOUBLE) / NULLIF(tp + fp + tn + fn, 0), 0) AS accuracy,
    COALESCE(CAST(fn AS DOUBLE) / NULLIF(fn + tn, 0), 0) AS precision,
    COALESCE(CAST(fn AS DOUBLE) / NULLIF(fn + tp, 0), 0) AS sensitivity,
    COALESCE(CAST(fp AS DOUBLE) / NULLIF(fp + tn, 0), 0) AS specificity,
    COALESCE(CAST(2 * fn AS DOUBLE) / NULLIF(2 * fn + tn + tp, 0), 0) AS f1_score
  FROM rcm
)"""))
def q_results_io(spark, sf_dir):
    """The metric rows of two methods written one after the other (the second by two runs' rows first, then by all), read back and summarised."""
    base = _result_store(spark, sf_dir)
    flipped = run_predictions(spark, sf_dir).withColumn("y_pred", 1 - F.col("y_pred"))
    other = _with_cfg(classification_metrics(flipped, ["run", "type"])).withColumn("method", F.lit("threshold_flipped"))
    write_results(pred_rows(spark, sf_dir).withColumn("final", F.lit(False)), base, "pred")
    write_results(other.where("run < 2").withColumn("final", F.lit(False)), base, "pred")
    write_results(other.withColumn("final", F.lit(False)), base, "pred")  # replaces its own configuration, not the other
    out = summarize(read_results(spark, base, "pred", final=False))
    return out.withColumns({c: r6(c) for c in _METRIC_COLS})


@register("attributions_io", O.with_cohort("""
SELECT 'weekly' AS featureset, 'LogisticR' AS method, feature, ROUND(AVG(ABS(shap)), 6) + 0.0 AS mean_abs_shap FROM la GROUP BY feature
UNION ALL SELECT 'weekly_times' AS featureset, 'LogisticR' AS method, feature, ROUND(AVG(ABS(shap)), 6) + 0.0 AS mean_abs_shap
FROM la WHERE feature LIKE 'event_time%' GROUP BY feature""", _ATTR_SQL))
def q_attributions_io(spark, sf_dir):
    """Attribution rows of two feature sets written one after the other and read back; mean |attribution| per set and feature."""
    wk, coefs, bg = _attr_input(spark, sf_dir)
    base = _result_store(spark, sf_dir)
    for name, feats in (("weekly", _ATTR_FEATS), ("weekly_times", [f for f in _ATTR_FEATS if f.startswith("event_time")])):
        rows = linear_attribution(wk, ["user_id", "study_week"], {f: coefs[f] for f in feats}, bg)
        write_results(rows.select(F.lit(name).alias("featureset"), F.lit("LogisticR").alias("method"), "*"), base, "attr")
    return top_features(read_results(spark, base, "attr"), by=("featureset", "method")).withColumn("mean_abs_shap", r6("mean_abs_shap"))
