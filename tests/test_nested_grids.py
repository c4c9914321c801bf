"""Ensembles scored at several sizes in one pass, and grids tuned by them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators import modeling as M
from dosewise.operators.evaluation import classification_metrics

FEATS = ["a", "b (t-1)", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0.3).astype(int)
    return spark.createDataFrame(pd.DataFrame({"pid": rng.integers(0, 30, 300), **dict(zip(FEATS, x.T)), "y": y})).cache()


def _specificity(model, df):
    return classification_metrics(model.transform(df), [], "y", "y_pred").first()["specificity"]


def test_boosted_stages_equal_separate_fits(frame):
    train, test = frame.where("pid < 20"), frame.where("pid >= 20")
    p = {"learning_rate": 0.3, "max_depth": 2, "gamma": 0.5}
    most = M.fit(train, FEATS, "y", "XGB", {**p, "n_estimators": 9}, 3)
    got = M.staged_scores(most, test, [2, 5, 9], "y")
    for n in (2, 5, 9):
        assert got[n] == pytest.approx(_specificity(M.fit(train, FEATS, "y", "XGB", {**p, "n_estimators": n}, 3), test), abs=1e-12)


def test_forest_prefixes_equal_the_votes_of_their_trees(frame):
    train, test = frame.where("pid < 20"), frame.where("pid >= 20")
    forest = M.fit(train, FEATS, "y", "RF", {"n_estimators": 12, "max_depth": 3}, 3)
    got = M.staged_scores(forest, test, [1, 5, 12], "y")
    assert got[12] == pytest.approx(_specificity(forest, test), abs=1e-12)
    from pyspark.ml.functions import vector_to_array

    rows = M.assemble(test, FEATS, "y").select("label", "features")
    votes = np.array([[t.transform(rows).select(vector_to_array("probability")[1]).toPandas().iloc[:, 0]] for t in forest.model.trees[:5]])[:, 0, :]
    label = rows.toPandas()["label"].to_numpy()
    for n in (1, 5):
        assert got[n] == pytest.approx(np.mean(votes[:n].mean(axis=0)[label == 0] <= 0.5 + 1e-12))


@pytest.mark.parametrize("method, grid, fits", [
    ("RF", {"n_estimators": [3, 6], "max_depth": [1, 2], "min_samples_leaf": [1]}, 2 * 3 + 1),
    ("XGB", {"gamma": [0.5], "learning_rate": [0.1, 0.3], "max_depth": [2], "min_child_weight": [1], "n_estimators": [2, 4]}, 2 * 3 + 1),
    ("SVM", {"C": [1, 10], "gamma": [0.1]}, 2 * 3 + 1)])
def test_tuned_step_of_every_grid(spark, frame, monkeypatch, method, grid, fits):
    calls, own = [], M.fit

    def counted(*a, **kw):
        calls.append(a)
        return own(*a, **kw)

    monkeypatch.setattr(M, "fit", counted)
    tuned = M.tune
    monkeypatch.setattr(M, "tune", lambda *a, **kw: tuned(*a, **kw, inner_folds=3))
    train, test = frame.where("pid < 20"), frame.where("pid >= 20")
    ptr, pte, model, _ = M.train_test(train, test, FEATS, "y", "pid", method, 5, tuned=True, grid=grid, impute=False, oversample=False)
    assert len(calls) == fits and {k: v for k, v in model.params.items()} in M.param_points(method, grid)
    assert pte.count() == test.count() and ptr.where(F.col("score").isNull()).count() == 0
