"""Models on separable synthetic data, result summaries, attributions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators.attribution import linear_attribution
from dosewise.operators.evaluation import classification_metrics
from dosewise.operators.folds import group_folds, split_by_fold
from dosewise.operators.modeling import fit, select_by_forest, train_test
from dosewise.operators.results import condense, lag_tuning_curve, run_name, summarize, top_features


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 600
    x1, x2, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (x1 + 0.5 * x2 > 0).astype(int)
    pdf = pd.DataFrame({"pid": np.arange(n) // 4, "x1": x1, "x2": x2, "noise": noise, "y": y})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["LogisticR", "RF", "XGB"])
def test_methods_learn_separable_data(spark, data, method):
    folds = group_folds(data, "pid", "y", k=2, seed=1)
    tr, te = split_by_fold(data, folds, "pid", 0)
    params = {"n_estimators": 20, "max_depth": 3} if method != "LogisticR" else {"C": 100.0}
    _, pte, _, _ = train_test(tr, te, ["x1", "x2", "noise"], "y", "pid", method, 7, params=params)
    m = classification_metrics(pte, [], "y_true", "y_pred").first()
    assert m.accuracy > 0.85
    assert pte.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_svm_and_determinism(spark, data):
    m1 = fit(data, ["x1", "x2"], "y", "SVM", {"C": 10.0, "gamma": 0.5}, seed=3)
    p = m1.transform(data.select("pid", F.col("y").alias("y_true"), "x1", "x2"))
    assert classification_metrics(p).first().accuracy > 0.85
    a = fit(data, ["x1", "x2", "noise"], "y", "RF", {"n_estimators": 10, "max_depth": 2}, seed=3)
    b = fit(data, ["x1", "x2", "noise"], "y", "RF", {"n_estimators": 10, "max_depth": 2}, seed=3)
    assert a.model.featureImportances == b.model.featureImportances
    assert "noise" not in select_by_forest(data, ["x1", "x2", "noise"], "y", seed=3)


def test_summary_fill_condense_and_names(spark):
    rows = [("fs", "LR", False, True, t, r, 0.5 + 0.1 * r, 0.6, 0.7, 0.8, 0.9) for t in ("train", "test")
            for r in range(3)]
    pred = spark.createDataFrame(rows, "featureset string, method string, features_selected boolean, tuned boolean, "
                                       "type string, run int, accuracy double, precision double, sensitivity double, "
                                       "specificity double, f1_score double")
    aucs = spark.createDataFrame([("fs", "LR", False, True, "test", 0.7, 0.05)],
                                 "featureset string, method string, features_selected boolean, tuned boolean, "
                                 "type string, auc_mean double, auc_std double")
    s = {r.type: r for r in summarize(pred, aucs).collect()}
    assert s["train"].auc_mean == -1 and abs(s["test"].accuracy_mean - 60.0) < 1e-9
    assert abs(s["test"].f1_score_mean - 0.9) < 1e-12  # f1 is not scaled
    c = {r.type: r for r in condense(summarize(pred, aucs)).collect()}
    assert c["test"].auc == "0.700 $\\pm$ 0.050"
    n = spark.createDataFrame([("study_day", "RF", 3, 2, True, True)],
                              "featureset string, method string, n_lags int, max_depth int, tuned boolean, final boolean")
    assert n.select(run_name()).first()[0] == "study_day_RF_3_lags_max_depth_2_tuned_final_clf"
    lt = spark.createDataFrame([(1, 3, "study_day", "test", 0.5), (1, 3, "study_day", "test", 0.7)],
                               "max_depth int, n_lags int, featureset string, type string, specificity double")
    assert abs(lag_tuning_curve(lt).first().specificity_mean - 0.6) < 1e-12


def test_linear_attribution_sums_to_centered_prediction(spark, data):
    coefs = {"x1": 2.0, "x2": -1.0}
    attr = linear_attribution(data.withColumn("rid", F.monotonically_increasing_id()), ["rid"], coefs, data)
    per_row = attr.groupBy("rid").agg(F.sum("shap").alias("s"))
    pdf = data.toPandas()
    pred = 2 * pdf.x1 - pdf.x2
    total = per_row.agg(F.sum("s")).first()[0]
    assert abs(total - (pred - pred.mean()).sum()) < 1e-6
    top = top_features(attr).collect()
    assert [r.feature for r in top] == ["x1", "x2"]


def test_predict_all_methods_and_tune_lags_small(spark):
    from conftest import SF_SMALL
    from dosewise.operators.lagging import prepare
    from dosewise.operators.modeling import predict_all_methods, tune_lags
    from dosewise.plans.featuresets import category_levels_for, featureset

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    fs = featureset(ev, "study_day")
    lagged = prepare(fs, n_lags=1, levels=category_levels_for())
    out = predict_all_methods(lagged, methods=("LogisticR",), runs=1, k=2)
    assert {r.type for r in out["pred"].collect()} == {"train", "test"}
    assert out["final_auc"].count() == 1 and out["roc"].where("j = 99").count() == 1
    rows = tune_lags(fs, lag_range=[1], depth_range=[1], runs=1, k=2, exclusion={"study_day": 10})
    r = rows.where("type = 'test'").first()
    assert (r.n_lags, r.max_depth, r.method) == (1, 1, "RF")
    assert fs.df.count() > 0  # the input feature set is not filtered in place


def test_sampled_attribution_is_additive(spark, data):
    from dosewise.operators.attribution import sampled_attribution

    feats = ["x1", "x2", "noise"]
    model = fit(data, feats, "y", "RF", {"n_estimators": 10, "max_depth": 3}, seed=1)
    rows = data.limit(20)
    bg = data.orderBy("pid", "x1").limit(1)
    rows = rows.unionByName(rows.limit(5))  # equal rows are explained one by one
    attr = sampled_attribution(model, rows, ["pid", "x1", "x2", "noise"], feats, bg, n_samples=4, seed=5)
    sums = sorted(r.s for r in attr.groupBy("_rid").agg(F.sum("shap").alias("s")).collect())
    fb = model.transform(bg.withColumn("y_true", F.col("y"))).first().score
    want = sorted(r.score - fb for r in model.transform(rows.withColumn("y_true", F.col("y"))).collect())
    assert len(sums) == 25
    np.testing.assert_allclose(sums, want, atol=1e-9)


def test_sampled_attribution_is_exact_on_a_linear_score_and_stops(spark, data):
    from dosewise.operators.attribution import _stride, sampled_attribution

    class Linear:
        calls = 0

        def transform(self, df):
            Linear.calls += 1
            return df.withColumn("score", 2 * F.col("x1") - F.col("x2") + 0.5 * F.col("noise"))

    feats, coefs = ["x1", "x2", "noise"], {"x1": 2.0, "x2": -1.0, "noise": 0.5}
    rows = spark.createDataFrame([(i, float(i), float(i % 3), 1.0) for i in range(10)], "pid long, x1 double, x2 double, noise double")
    bg = spark.createDataFrame([(i, i * 0.3, i * i * 0.1, 1.0 if i else 0.0) for i in range(4)], rows.schema)
    means = {f: np.mean([r[f] for r in bg.collect()]) for f in feats}
    attr = sampled_attribution(Linear(), rows, ["pid", *feats], feats, bg, n_samples=8, seed=2)  # 4 pairs: each background row once
    by = {r.pid: r for r in rows.collect()}
    got = attr.collect()
    assert len(got) == 30 and all(abs(r.shap - coefs[r.feature] * (by[r.pid][r.feature] - means[r.feature])) < 1e-9 for r in got)
    assert all(r.stderr is not None and r.stderr > 0 for r in got if r.feature != "noise")
    Linear.calls = 0
    assert sampled_attribution(Linear(), rows, ["pid", *feats], feats, bg.limit(1), n_samples=4, max_error=0.0).where("stderr > 0").count() == 0
    assert Linear.calls == 1  # one background row: no spread, so the first batch is enough
    sampled_attribution(Linear(), rows, ["pid", *feats], feats, bg, n_samples=4, max_error=1e-12, max_samples=12)
    assert Linear.calls == 4  # never small enough: three batches of 4 orders
    assert all(len({(k * _stride(n)) % n for k in range(n)}) == n for n in (1, 2, 3, 6, 10, 1000))


def test_fitted_linear_attribution_adds_up_to_the_margin(spark, data):
    from dosewise.operators.attribution import fitted_linear_attribution

    feats = ["x1", "x2", "noise"]
    model = fit(data, feats, "y", "LogisticR", {"C": 1.0}, seed=1)
    attr = fitted_linear_attribution(model, data.withColumn("k", F.monotonically_increasing_id()), ["k"], data)
    got = sorted(r.s for r in attr.groupBy("k").agg(F.sum("shap").alias("s")).collect())
    x = data.select(*feats).toPandas().to_numpy()
    want = np.sort((x - x.mean(axis=0)) @ model.model.coefficients.toArray())
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("method,params", [("LogisticR", {"C": 1.0}), ("RF", {"n_estimators": 5, "max_depth": 2}), ("SVM", {"C": 1.0, "gamma": 0.5})])
def test_fitted_models_save_and_load(spark, data, tmp_path, method, params):
    from dosewise.operators.modeling import load_fitted, save_fitted

    model = fit(data, ["x1", "x2"], "y", method, params, seed=3)
    save_fitted(model, str(tmp_path / method))
    back = load_fitted(str(tmp_path / method))
    assert (back.method, back.features, back.params) == (model.method, model.features, model.params)
    a, b = (sorted(r.score for r in m.transform(data).select("score").collect()) for m in (model, back))
    assert a == b


def test_csv_folder_is_read_by_name(spark, tmp_path):
    from dosewise.operators.results import pretty_columns, read_csv_glob, tags_from_file_name, to_numeric

    (tmp_path / "study_day_RF_3_lags_pred.csv").write_text("Unnamed: 0,method,run,f1_score\n0,RF,1,0.5\n")
    (tmp_path / "study_day_LR_3_lags_final_clf_pred.csv").write_text("Unnamed: 0,max_depth,f1_score,method\n0,NA,0.25,LR\n")
    df = to_numeric(read_csv_glob(spark, str(tmp_path / "*_pred.csv")), ["f1_score", "max_depth"])
    df = df.withColumns({f"tag_{k}": v for k, v in tags_from_file_name().items()})
    rows = {r.method: r for r in df.collect()}
    assert (rows["RF"].run, rows["RF"].f1_score, rows["RF"].max_depth) == ("1", 0.5, None)
    assert (rows["LR"].run, rows["LR"].f1_score, rows["LR"].max_depth) == (None, 0.25, None)
    assert (rows["RF"].tag_method, rows["LR"].tag_featureset) == ("RF", "study_day")
    assert [r.method for r in read_csv_glob(spark, str(tmp_path / "*_pred.csv"), final=True).collect()] == ["LR"]
    assert pretty_columns(df).columns[:2] == ["Max depth", "F1 score"] or "F1 score" in pretty_columns(df).columns
