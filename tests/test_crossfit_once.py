"""Work of a repeated cross-validation that is done once: nominal modes per list of neighbours, vectors per training side."""

import numpy as np
import pandas as pd
import pytest

from dosewise.operators import crossfit, oversample
from dosewise.operators import modeling as M

FEATS = ["a", "b", "c"]


def _frame(spark, n=300):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.3).astype(int)
    return spark.createDataFrame(pd.DataFrame({"pid": rng.integers(0, 30, n), "a": np.round(rng.normal(size=n) + y, 2), "b": rng.integers(0, 3, n), "c": rng.integers(0, 2, n), "y": y}))


def test_modes_of_lists(spark):
    lists = spark.createDataFrame([
        (0, [([1.0], ["1", "x"]), ([2.0], ["0", "y"]), ([3.0], ["0", "z"])]),
        (1, [([1.0], [None, "b"]), ([2.0], ["1", "a"]), ([3.0], ["1", "b"]), ([4.0], [None, "a"])]),
        (2, [])], "i int, _nb array<struct<_v:array<double>,_nv:array<string>>>")
    got = {r["i"]: r for r in oversample.drawn_lists(lists, ["p", "q"]).collect()}
    assert got[0]["_mode"] == ["0", "x"] and got[0]["_nb"] == [[1.0], [2.0], [3.0]]
    assert got[1]["_mode"] == [None, "a"]  # lowest on ties, null before all
    assert got[2]["_mode"] == [None, None] and got[2]["_nb"] == []
    assert oversample.drawn_lists(lists, []).where("i = 0").first()["_mode"] == []


def test_lists_hold_their_modes(spark):
    made = crossfit.CrossFit(_frame(spark), FEATS, "y", "pid", runs=1, folds=2, nominal=("b", "c"))
    lists = made.lists[1].collect()
    assert lists and all(len(r["_mode"]) == 2 and len(r["_nb"][0]) == 1 for r in lists)


@pytest.mark.parametrize("kw, frames", [({}, 2), ({"select_feats": True}, 3)])
def test_vectors_of_a_side_are_assembled_once(spark, monkeypatch, kw, frames):
    df, calls, own = _frame(spark), [], M.assemble
    monkeypatch.setattr(M, "assemble", lambda *a: calls.append(a) or own(*a))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    mets, _, _ = M.repeated_cv(df, FEATS, "y", "pid", "LogisticR", runs=1, k=2, nominal=["b", "c"], impute=False, params={"C": 1.0}, **kw)
    assert len(calls) == 2 * frames  # of each side: training rows (and their selection), test rows
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    assert mets.count() == 2


def test_held_vectors_give_the_same_predictions(spark):
    df = _frame(spark)
    train, test = df.where("pid < 20"), df.where("pid >= 20")
    for method in ("LogisticR", "RF"):
        args = (train, test, FEATS, "y", "pid", method, 3)
        kw = {"params": {"n_estimators": 5, "max_depth": 2}, "impute": False, "oversample": False}
        held: list = []
        want, got = M.train_test(*args, **kw), M.train_test(*args, **kw, held=held)
        assert len(held) == 1
        for a, b in zip(want[:2], got[:2]):
            a, b = (sorted(map(tuple, x.collect())) for x in (a, b))
            assert len(a) == len(b)
            np.testing.assert_allclose(a, b, atol=1e-9)
        held[0].unpersist()
