"""Lags, one-hot, folds, sampling, ROC/AUC, correlation, VIF, histogram, imputation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators.collinearity import correlated_to_drop, histogram, pearson, row_stats, vif
from dosewise.operators.encoding import one_hot
from dosewise.operators.evaluation import (auc, classification_metrics, interpolate_tpr, mean_auc, mean_roc,
                                           roc_curve, roc_points)
from dosewise.operators.folds import group_folds, seeded_sample
from dosewise.operators.lagging import FeatureSet, lag_features, prepare
from dosewise.operators.scaling import chained_impute, minmax, mode_fill


def test_lag_features_shift_by_row(spark):
    rows = [(u, w, float(u * 10 + w), (u + w) % 2) for u in (1, 2) for w in (1, 2, 4, 5)] + [(3, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "user_id long, study_week int, x double, adherent int")
    out, mapping = lag_features(df, "user_id", "study_week", "adherent", n_in=2)
    assert out.columns == ["user_id", "x (t-2)", "adherent (t-2)", "x (t-1)", "adherent (t-1)", "adherent"]
    got = sorted((r["user_id"], r["x (t-2)"], r["x (t-1)"]) for r in out.collect())
    # week 3 is missing: the lag is by row, so week 4's (t-1) is week 2
    assert got == [(1, 11.0, 12.0), (1, 12.0, 14.0), (2, 21.0, 22.0), (2, 22.0, 24.0)]
    assert mapping["x"] == ["x (t-2)", "x (t-1)"]


def test_prepare_one_hot_and_nominals(spark):
    rows = [(1, d, ["a", "b", None][d % 3], d % 2) for d in range(1, 7)]
    df = spark.createDataFrame(rows, "user_id long, study_day int, cat string, adherent int")
    fs = FeatureSet(df=df, name="study_day", id_col="user_id", target_col="adherent", horizon="study_day",
                    nominal_cols=("adherent",), categorical_cols=("cat",))
    out = prepare(fs, n_lags=1, levels={"cat": ["a", "b"]})
    assert out.df.columns[-1] == "adherent"
    assert "cat_a (t-1)" in out.nominal_cols and "adherent (t-1)" not in out.nominal_cols
    enc, new = one_hot(df, ["cat"])
    assert new == ["cat_a", "cat_b"]
    assert enc.where(F.col("cat_a") + F.col("cat_b") == 0).count() == 2  # NULL -> all zero


def test_group_folds_partition_and_balance(spark):
    rows = [(u, i, int(i < (u % 5))) for u in range(200) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id long, i int, y int")
    f = group_folds(df, "user_id", "y", k=5, seed=3).toPandas()
    assert f.user_id.is_unique and set(f.fold) == set(range(5))
    for _, g in f.groupby("stratum"):
        sizes = g.fold.value_counts()
        assert sizes.max() - sizes.min() <= 1
    again = group_folds(df, "user_id", "y", k=5, seed=3).toPandas()
    assert f.sort_values("user_id").fold.tolist() == again.sort_values("user_id").fold.tolist()


def test_seeded_sample_size_and_determinism(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = [r.k for r in seeded_sample(df, 1000, 1, ["k"]).collect()]
    b = [r.k for r in seeded_sample(df.repartition(7), 1000, 1, ["k"]).collect()]
    assert len(a) == 1000 and sorted(a) == sorted(b)


def _np_roc(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.where(np.diff(s))[0]
    thr_idx = np.r_[idx, len(y) - 1]
    tps = np.cumsum(y)[thr_idx]
    fps = 1 + thr_idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    fps, tps = np.r_[0, fps[keep]], np.r_[0, tps[keep]]
    return fps / fps[-1], tps / tps[-1]


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    n = 3000
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 3)  # ties on purpose
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "y_true": y, "score": s, "y_pred": (s >= 0.5).astype(int)})
    return pdf, spark.createDataFrame(pdf)


def test_roc_curve_matches_numpy(spark, preds):
    pdf, df = preds
    for g, part in pdf.groupby("g"):
        fpr, tpr = _np_roc(part.y_true.to_numpy(), part.score.to_numpy())
        got = roc_curve(df, ["g"]).where(F.col("g") == int(g)).orderBy("idx").toPandas()
        np.testing.assert_allclose(got.fpr, fpr, atol=1e-12)
        np.testing.assert_allclose(got.tpr, tpr, atol=1e-12)


def test_auc_equals_rank_sum_and_interp_matches_numpy(spark, preds):
    pdf, df = preds
    pts = roc_points(df, ["g"])
    a = {r.g: r.auc for r in auc(pts, ["g"]).collect()}
    grid = np.linspace(0, 1, 100)
    it = interpolate_tpr(pts, ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        pos, neg = part.score[part.y_true == 1].to_numpy(), part.score[part.y_true == 0].to_numpy()
        rank = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert abs(a[g] - rank) < 1e-9
        fpr, tpr = _np_roc(part.y_true.to_numpy(), part.score.to_numpy())
        want = np.interp(grid, fpr, tpr)
        want[0] = 0.0
        got = it[it.g == g].sort_values("j")
        assert len(got) == 100
        np.testing.assert_allclose(got.tpr.to_numpy(), want, atol=1e-12)
    m = mean_auc(mean_roc(interpolate_tpr(pts, ["g"])), auc(pts, ["g"])).first()
    assert 0.5 < m.auc_mean < 1 and m.auc_std >= 0


def test_classification_metrics_conventions(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y_true int, y_pred int")
    r = classification_metrics(df).first()
    assert (r.accuracy, r.precision, r.sensitivity, r.specificity) == (0.75, 1.0, 0.5, 1.0)
    assert abs(r.f1_score - 2 / 3) < 1e-12 and r.support is None
    none = classification_metrics(spark.createDataFrame([(0, 0)], "y_true int, y_pred int")).first()
    assert none.precision == 0.0 and none.f1_score == 0.0


def test_pearson_vif_hist_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 0] * 0.9 + rng.normal(scale=0.1, size=400)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=1.0)
    df = spark.createDataFrame(pdf)
    r = {(q.col_a, q.col_b): q.r for q in pearson(df, ["a", "b", "c", "k"]).collect()}
    np.testing.assert_allclose(r[("a", "c")], np.corrcoef(x[:, 0], x[:, 2])[0, 1], atol=1e-9)
    assert r[("a", "k")] is None  # constant column: no division error
    assert correlated_to_drop(df, ["a", "b", "c"], 0.85) == ["c"]
    got = {q.feature: q.vif for q in vif(df, ["a", "b", "c"]).collect()}
    for i, c in enumerate("abc"):
        others = np.delete(x, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, x[:, i], rcond=None)
        rss = ((x[:, i] - others @ beta) ** 2).sum()
        np.testing.assert_allclose(got[c], (x[:, i] ** 2).sum() / rss, rtol=1e-8)  # uncentered
    h = histogram(df, ["a"], 10).orderBy("bin").toPandas()
    counts, _ = np.histogram(x[:, 0], bins=10)
    assert h["count"].tolist() == counts.tolist()


def test_row_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, None), (4.0, None, None)], "a double, b double, c double")
    out = row_stats(df, ["a", "b", "c"], "r_").collect()
    assert out[0].r_mean == 1.5 and abs(out[0].r_std - np.std([1, 2], ddof=1)) < 1e-12
    assert out[1].r_mean is None and out[2].r_std is None


def test_minmax_mode_fill_and_chained_impute(spark):
    df = spark.createDataFrame([(1.0, 5.0, "b"), (3.0, 5.0, "a"), (2.0, 5.0, None), (4.0, 5.0, "a")],
                               "x double, k double, c string")
    m = minmax(df, df, ["x", "k"]).collect()
    assert [r.x for r in m] == [0.0, 2 / 3, 1 / 3, 1.0] and {r.k for r in m} == {0.0}
    assert [r.c for r in mode_fill(df, ["c"]).collect()] == ["b", "a", "a", "a"]
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    b = 2 * a + 1 + rng.normal(scale=0.01, size=300)
    b_miss = b.copy()
    b_miss[:30] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b_miss})
    sdf = spark.createDataFrame(pdf).withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b")))
    (out,) = chained_impute(sdf, [sdf], ["a", "b"], rounds=2)
    filled = out.toPandas().b.to_numpy()[:30]
    np.testing.assert_allclose(filled, 2 * a[:30] + 1, atol=0.05)


def test_evidence_ridge_matches_the_posterior_in_matrix_form():
    from dosewise.operators.scaling import evidence_ridge

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * [1.0, 5.0, 0.1, 2.0]
    y = x @ [0.5, -0.2, 3.0, 0.0] + rng.normal(scale=0.4, size=80)
    x, y = x - x.mean(axis=0), y - y.mean()
    noise, weight, last = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for i in range(300):  # textbook form: the posterior's covariance and its trace
        cov = np.linalg.inv(weight * np.eye(4) + noise * x.T @ x)
        w = noise * cov @ x.T @ y
        gamma = 4 - weight * np.trace(cov)
        weight = (gamma + 2e-6) / (w @ w + 2e-6)
        noise = (len(y) - gamma + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if last is not None and np.abs(w - last).sum() < 1e-3:
            break
        last = w
    want = noise * np.linalg.inv(weight * np.eye(4) + noise * x.T @ x) @ x.T @ y
    np.testing.assert_allclose(evidence_ridge(80, x.T @ x, x.T @ y, y @ y), want, rtol=1e-9)
    assert (evidence_ridge(80, x.T @ x, np.zeros(4), 0.0) == 0).all()


def test_chained_impute_replays_and_stops(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    rows = [(float(v), None if i % 9 == 0 else float(3 * v - 1), None, None if i % 7 == 0 else float(-v)) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, never double, c double")
    other = spark.createDataFrame([(0.5, None, None, -0.5), (None, 2.0, None, -1.0)], df.schema)
    same, out = chained_impute(df, [df, other], ["a", "b", "never", "c"])
    assert same.columns == df.columns and same.where("a is null or b is null or c is null or never != 0").count() == 0
    got = same.toPandas()
    np.testing.assert_allclose(got.b, 3 * got.a - 1, atol=0.02)
    r = out.collect()
    assert abs(r[0].b - 0.5) < 0.05 and abs(r[1].a - 1.0) < 0.05
    assert chained_impute(df.limit(0), [df.limit(0)], ["a", "b"])[0].count() == 0
