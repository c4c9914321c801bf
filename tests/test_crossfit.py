"""Training sides made together equal SMOTE and min-max of each side on its own."""

import numpy as np
import pandas as pd
import pytest

from dosewise.operators import crossfit
from dosewise.operators.crossfit import CrossFit
from dosewise.operators.folds import group_folds
from dosewise.operators.oversample import smote
from dosewise.operators.scaling import minmax_fit


def _frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"pid": rng.integers(0, 30, n), "a": np.round(rng.normal(size=n) + y, 2), "b (t-1)": rng.integers(0, 4, n), "c": rng.integers(0, 3, n), "d": rng.integers(0, 2, n), "y": y})
    return spark.createDataFrame(pd.concat([pdf, pdf[:40]]))  # copies too


def _rows(df, cols):
    return np.array(sorted(tuple(float(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()))


@pytest.mark.parametrize("nominal, lists, longest", [((), 4, 1000), (("c", "d"), 2, 1000), (("c", "d"), 1, 5)])
def test_sides_equal_smote_of_each_training_side(spark, monkeypatch, nominal, lists, longest):
    monkeypatch.setattr(crossfit, "LISTS", lists)  # short lists: some are made longer, or searched on their side
    monkeypatch.setattr(crossfit, "LONGEST", longest)
    df, feats = _frame(spark), ["a", "b (t-1)", "c", "d"]
    made = CrossFit(df, feats, "y", "pid", runs=2, folds=3, nominal=nominal)
    for run in range(2):
        folds = group_folds(df, "pid", "y", 3, run).select("pid", "fold")
        synthetic = made.synthetic(run)
        for fold in range(3):
            train = df.join(folds, "pid").where(f"fold <> {fold}").drop("fold")
            want = smote(train, feats, "y", "pid", k=5, seed=run, nominal=nominal)
            cols = ["pid", *feats, "y"]
            np.testing.assert_allclose(_rows(synthetic.where(f"_side = {fold}"), cols), _rows(want.where("synthetic = 1"), cols), atol=1e-9)
            got, test = made.side(run, fold, synthetic)
            np.testing.assert_allclose(_rows(got, cols), _rows(want, cols), atol=1e-9)
            assert test.count() == df.join(folds, "pid").where(f"fold = {fold}").count()
            assert made.ranges[run, fold] == {f: tuple(map(float, v)) for f, v in minmax_fit(train, feats).items()}


def test_sides_without_a_minority(spark):
    df = _frame(spark).where("y = 0")
    made = CrossFit(df, ["a", "c"], "y", "pid", runs=1, folds=2)
    assert made.synthetic(0) is None and made.side(0, 0, None)[0].count() + made.side(0, 1, None)[0].count() == df.count()
