"""Leaf-path attributions against all coalitions, of stated trees and of fitted models."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators import modeling
from dosewise.operators import tree_attribution as T

FEATS = ["a", "b (t-1)", "c"]


def _score(trees, x):
    out = 0.0
    for nodes, weight in trees:
        at = 0
        while nodes[at][0] >= 0:
            feature, threshold, left, right, _ = nodes[at]
            at = left if x[feature] <= threshold else right
        out += weight * nodes[at][4]
    return out


def _coalitions(trees, x, background):
    p = len(x)
    out = np.zeros(p)
    for z in background:
        for size in range(p):
            for s in itertools.combinations(range(p), size):
                w = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                for j in set(range(p)) - set(s):
                    mixed = [x[i] if i in s else z[i] for i in range(p)]
                    with_j = list(mixed)
                    with_j[j] = x[j]
                    out[j] += w * (_score(trees, with_j) - _score(trees, mixed))
    return out / len(background)


def _frame(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)  # ties with thresholds
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    return x, spark.createDataFrame(pd.DataFrame({"i": range(n), **dict(zip(FEATS, x.T)), "y": y}))


def _values(df):
    return {(r["i"], r["feature"]): r["shap"] for r in df.collect()}


@pytest.mark.parametrize("method", ["stated", "RF", "XGB"])
def test_equals_all_coalitions(spark, method):
    x, df = _frame(spark)
    if method == "stated":  # one feature twice on a path, a leaf at the root, a feature in no tree
        trees = [({0: (0, 0.5, 1, 2, 0), 1: (0, -0.5, 3, 4, 0), 2: (-1, 0, 0, 0, 3.0), 3: (-1, 0, 0, 0, -1.0), 4: (1, 0.0, 5, 6, 0), 5: (-1, 0, 0, 0, 2.0), 6: (-1, 0, 0, 0, 0.5)}, 0.7),
                 ({0: (-1, 0, 0, 0, 5.0)}, 1.0)]
    else:
        fitted = modeling.fit(df, FEATS, "y", method, {"n_estimators": 4, "max_depth": 3}, 7)
        trees = T.model_trees(spark, fitted)
    paths = T.leaf_paths(spark, trees)
    background = df.where("i < 15")
    got = _values(T.tree_attribution(paths, df.where("i >= 100"), ["i"], FEATS, background))
    assert len(got) == 60
    base = T.base_value(paths, FEATS, background)
    np.testing.assert_allclose(base, np.mean([_score(trees, z) for z in x[:15]]), atol=1e-9)
    for i in range(100, 120):
        want = _coalitions(trees, x[i], x[:15])
        mine = [got[i, f] for f in FEATS]
        np.testing.assert_allclose(mine, want, atol=1e-9)
        np.testing.assert_allclose(sum(mine), _score(trees, x[i]) - base, atol=1e-9)
    if method == "RF":  # the scores of the path table are the model's
        scores = {r["i"]: r["score"] for r in fitted.transform(df).select("i", "score").collect()}
        np.testing.assert_allclose([scores[i] for i in range(120)], [_score(trees, v) for v in x], atol=1e-9)


def test_equals_duckdb_on_the_path_table(spark):
    _, df = _frame(spark, 60, 3)
    fitted = modeling.fit(df, FEATS, "y", "RF", {"n_estimators": 6, "max_depth": 3}, 5)
    paths = T.leaf_paths(spark, T.model_trees(spark, fitted))
    got = _values(T.tree_attribution(paths, df, ["i"], FEATS, df.where("i < 20")))
    p, d = paths.where("feature is not null").toPandas(), df.toPandas()
    d = d.rename(columns=dict(zip(FEATS, ["f0", "f1", "f2"])))
    con = duckdb.connect()
    con.register("p", p)
    con.register("d", d)
    want = con.sql("""
        WITH l AS (SELECT i, unnest([0, 1, 2]) AS feature, unnest([f0, f1, f2]) AS x FROM d),
        m AS (SELECT p.leaf, p.value, p.feature, u.i, z.i AS zi, u.x > low AND u.x <= high AS mx, z.x > low AND z.x <= high AS mz
              FROM p JOIN l u ON u.feature = p.feature JOIN l z ON z.feature = p.feature AND z.i < 20),
        g AS (SELECT i, zi, leaf, count(*) FILTER (mx AND NOT mz) AS a, count(*) FILTER (mz AND NOT mx) AS b FROM m GROUP BY 1, 2, 3 HAVING bool_and(mx OR mz))
        SELECT m.i, m.feature, sum(value * CASE WHEN mx AND NOT mz THEN (factorial(CAST(a - 1 AS INT)) * factorial(CAST(b AS INT)))::DOUBLE / factorial(CAST(a + b AS INT))
                                          WHEN mz AND NOT mx THEN -(factorial(CAST(a AS INT)) * factorial(CAST(b - 1 AS INT)))::DOUBLE / factorial(CAST(a + b AS INT)) ELSE 0 END) / 20 AS shap
        FROM m JOIN g USING (i, zi, leaf) GROUP BY 1, 2""").fetchall()
    want = {(i, FEATS[f]): s for i, f, s in want}
    for key, value in got.items():
        assert abs(value - want.get(key, 0.0)) < 1e-9
    assert T.tree_attribution(paths, df.limit(0), ["i"], FEATS, df).count() == 0
