"""Exact neighbours (vs brute force) and SMOTE / SMOTE-NC properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators.oversample import neighbours, smote


def _points(spark, x):
    return spark.createDataFrame([([float(v) for v in row], []) for row in x], "_v array<double>, _nv array<string>")


def _lists(df):
    return {tuple(r._v): [tuple(n._v) for n in r._nb] for r in df.collect()}


def test_neighbours_exact_in_one_leaf(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 4)), 6)
    x[150:] = x[0]  # a block of 50 copies (51 with x[0])
    got = _lists(neighbours(_points(spark, x), 5, seed=1))
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    assert len(got) == 150
    for i in range(150):
        near = [((x[i] - np.array(n)) ** 2).sum() for n in got[tuple(x[i])]]
        np.testing.assert_allclose(near, np.sort(d2[i])[:5], atol=1e-9)


def _check_exact(got, x, k, c=None, penalty=0.0):
    """Every list holds the k nearest of all others, in order of distance."""
    at = {(tuple(map(float, a)), tuple(map(str, b))): i for i, (a, b) in enumerate(zip(x, c if c is not None else [[]] * len(x)))}
    assert len(got) == len(x)
    for r in got:
        i = at[tuple(r._v), tuple(r._nv)]
        d2 = ((x - x[i]) ** 2).sum(1) + (penalty * (c != c[i]).sum(1) if c is not None else 0)
        d2[i] = np.inf
        mine = [d2[at[tuple(m._v), tuple(m._nv)]] for m in r._nb]
        np.testing.assert_allclose(mine, np.sort(d2)[:k], atol=1e-9)


@pytest.mark.parametrize("n, kind", [(257, "binary"), (1500, "gaussian"), (1500, "binary"), (6000, "binary"), (6000, "gaussian")])
def test_neighbours_are_exact(spark, n, kind):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 12)) if kind == "gaussian" else rng.integers(0, 2, size=(n, 12)) + rng.normal(scale=0.1, size=(n, 12)), 6)
    _check_exact(neighbours(_points(spark, x), 5, seed=1, block=128 if n < 1000 else 512).collect(), x, 5)


def test_blocks_are_bounded_however_vectors_pile_up(spark):
    """One tight cluster holds most vectors, many at one distance from each other; another third lies on a grid full of ties."""
    from dosewise.operators import nearest as N
    from dosewise.operators.oversample import distinct_vectors

    rng = np.random.default_rng(3)
    heap = np.round(5 + rng.normal(scale=1e-3, size=(1500, 4)), 6)
    grid = np.array(np.meshgrid(*[np.arange(5)] * 4)).reshape(4, -1).T.astype(float)
    ring = np.eye(4)[rng.integers(0, 4, 300)] * 50 + np.round(rng.normal(size=(300, 4)), 6)
    x = np.unique(np.vstack([heap, grid, ring]), axis=0)
    pts = distinct_vectors(_points(spark, x)).cache()
    pivots = pts.orderBy("_vid").limit(12).toPandas()
    sizes = N._blocks(N._cells(pts.select("_vid", "_v", "_nv"), pivots, 0.0), 100).groupBy("_block").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 125 and sizes[1] == len(x)
    _check_exact(neighbours(_points(spark, x), 4, block=100).collect(), x, 4)


def test_few_queries_and_few_vectors(spark):
    from dosewise.operators.nearest import nearest
    from dosewise.operators.oversample import distinct_vectors

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 3)), 6)
    pts = distinct_vectors(_points(spark, x)).cache()
    some = pts.orderBy("_vid").limit(9).select("_vid")
    every = {(r._vid, r.nb) for r in nearest(pts, 5, rows=64).collect()}
    asked = {(r._vid, r.nb) for r in nearest(pts, 5, rows=64, only=some).collect()}
    ids = {r._vid for r in some.collect()}
    assert asked == {p for p in every if p[0] in ids} and len(asked) == 45
    tiny = pts.orderBy("_vid").limit(3)
    assert nearest(tiny, 5).count() == 6 and nearest(tiny, 5, rows=2).count() == 6  # all others, if fewer than k


def test_neighbours_with_nominals_are_exact(spark):
    rng = np.random.default_rng(12)
    x, c = np.round(rng.normal(size=(1200, 3)), 6), rng.integers(0, 3, size=(1200, 2))
    rows = [([float(v) for v in a], [str(v) for v in b]) for a, b in zip(x, c)]
    got = neighbours(spark.createDataFrame(rows, "_v array<double>, _nv array<string>"), 5, seed=1, penalty=0.8, block=200).collect()
    _check_exact(got, x, 5, c, 0.8)


def test_smote_integer_input_keeps_fractions(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(120) % 4 == 0).astype(int)
    pdf = pd.DataFrame({"pid": np.arange(120) % 9, "a": rng.integers(0, 2, 120), "b": rng.integers(0, 5, 120), "y": y})
    out = smote(spark.createDataFrame(pdf), ["a", "b"], "y", "pid", k=5, seed=3)
    assert dict(out.dtypes)["a"] == "double"
    syn = out.where("synthetic = 1").toPandas()
    assert ((syn.a % 1 != 0) | (syn.b % 1 != 0)).any()
    mino = pdf[pdf.y == 1][["a", "b"]].to_numpy(float)
    for a, b in syn[["a", "b"]].to_numpy():  # on the line between two minority rows
        d = mino - np.array([a, b])
        cross = np.abs(d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0])
        dots = d[:, None, 0] * d[None, :, 0] + d[:, None, 1] * d[None, :, 1]
        assert ((cross < 1e-9) & (dots <= 1e-9)).any()


def _data(spark, n=200):
    rng = np.random.default_rng(9)
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame({"pid": rng.integers(0, 40, n), "a": rng.normal(size=n) + 2 * y,
                        "b": rng.normal(size=n), "c": rng.integers(0, 3, n), "y": y})
    return pdf, spark.createDataFrame(pdf)


def test_smote_balances_and_interpolates(spark):
    pdf, df = _data(spark)
    out = smote(df, ["a", "b"], "y", "pid", k=5, seed=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic = 1").toPandas()
    mino = pdf[pdf.y == 1]
    assert set(syn.pid) <= set(mino.pid)  # synthetic rows keep a minority subject id
    assert syn.a.between(mino.a.min(), mino.a.max()).all() and syn.b.between(mino.b.min(), mino.b.max()).all()
    again = smote(df, ["a", "b"], "y", "pid", k=5, seed=3).where("synthetic = 1").toPandas()
    assert sorted(zip(syn.a.round(9), syn.b.round(9))) == sorted(zip(again.a.round(9), again.b.round(9)))


def test_smote_nc_and_small_minority_fallback(spark):
    pdf, df = _data(spark)
    out = smote(df, ["a", "b", "c"], "y", "pid", k=5, seed=3, nominal=["c"])
    syn = out.where("synthetic = 1").toPandas()
    assert set(syn.c) <= {0, 1, 2} and (syn.c == syn.c.round()).all()
    tiny = df.where("y = 0").unionByName(df.where("y = 1").orderBy(F.desc("a")).limit(3))
    out2 = smote(tiny, ["a", "b"], "y", "pid", k=5, seed=1)  # k falls back to minority - 1
    c2 = {r.y: r["count"] for r in out2.groupBy("y").count().collect()}
    assert c2[0] == c2[1]
