"""Boosted grids grown together equal separate fits; the query tunes the whole published grid."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators import boosting
from dosewise.operators import modeling as M
from dosewise.plans import q_model
from dosewise.plans.registry import QUERIES

FEATS = ["a", "b (t-1)", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=700), np.round(rng.normal(size=700), 1), rng.integers(0, 2, 700), rng.integers(0, 3, 700)])
    y = (x[:, 0] * x[:, 2] + 0.5 * x[:, 1] + 0.8 * rng.normal(size=700) > 0.1).astype(int)
    return spark.createDataFrame(pd.DataFrame({"pid": rng.integers(0, 40, 700), **dict(zip(FEATS, x.T)), "y": y})).cache()


def test_cuts_are_nearest_to_even_counts():
    values, counts = np.arange(6.0), np.array([1, 1, 10, 1, 1, 1])
    assert list(boosting.cuts_of(values, counts, 5)) == [0.5, 1.5, 2.5, 3.5, 4.5]
    assert list(boosting.cuts_of(values, counts, 2)) == [1.5, 2.5]  # targets 5 and 10 of 15
    assert len(boosting.cuts_of(values[:1], counts[:1], 2)) == 0


@pytest.mark.parametrize("chunk", [32768, 100])
def test_grid_grown_together_equals_separate_fits(frame, monkeypatch, chunk):
    monkeypatch.setattr(boosting, "CHUNK", chunk)
    grid = {"gamma": [0.5, 20], "learning_rate": [0.3], "max_depth": [3], "min_child_weight": [1, 30], "n_estimators": [3, 6]}
    data = M.group_folds(frame, "pid", "y", 2, 1).select("pid", "fold").join(frame, "pid").cache()
    pts = M.param_points("XGB", grid)
    got = M._scored_together(data, FEATS, "y", pts, 5, 2)
    assert all(len(g) == len(pts) == 8 for g in got)
    for p in [p for p in pts if p["n_estimators"] == 6]:
        for f in range(2):
            want = M.staged_scores(M.fit(data.where(F.col("fold") != f), FEATS, "y", "XGB", p, 5), data.where(F.col("fold") == f), [3, 6], "y")
            for n, v in want.items():
                assert got[f][json.dumps({**p, "n_estimators": n})] == pytest.approx(v, abs=1e-12)
    assert len({json.dumps(sorted(g.values())) for g in got}) == 2


def test_large_grid_takes_one_fit(frame, monkeypatch):
    calls, own = [], M.fit
    monkeypatch.setattr(M, "fit", lambda *a, **kw: calls.append(a) or own(*a, **kw))
    grid = {"gamma": [0.5, 1], "learning_rate": [0.1, 0.3], "max_depth": [2], "min_child_weight": [1], "n_estimators": [2, 4]}
    model = M.tune(frame, FEATS, "y", "pid", "XGB", 5, grid)
    assert len(calls) == 1 and model.params in M.param_points("XGB", grid)


def test_query_tunes_the_published_grid(spark, monkeypatch):
    asked = {}

    def step(*a, grid=None, **kw):
        asked.update(kw, points=M.param_points("XGB", grid))
        raise KeyError("far enough")

    monkeypatch.setattr(q_model, "_final_split", lambda *a: (None, None, FEATS, type("fs", (), {"target_col": "y", "id_col": "pid", "nominal_cols": ()})))
    monkeypatch.setattr(q_model, "train_test", step)
    with pytest.raises(KeyError, match="far enough"):
        QUERIES["grid_search_gbt"](spark, "")
    assert asked["tuned"] and len(asked["points"]) == 3 ** 5 and {p["n_estimators"] for p in asked["points"]} == {100, 250, 500}
