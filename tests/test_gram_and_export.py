"""Masked co-moments against numpy, and CSV exports with ragged rows."""

import numpy as np
import pandas as pd
import pytest

from dosewise.operators.collinearity import gram, pearson, vif
from dosewise.sources.export import read_wide_csv, write_wide_csv


def test_forty_columns_with_nulls_against_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 40)) @ rng.normal(size=(40, 40)) + 1e4 * rng.random(40)  # far from zero
    x[:, 7] = 3.1  # constant
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:300, 11], x[300:, 12] = np.nan, np.nan  # never present together
    pdf = pd.DataFrame(x, columns=[f"c {i}" for i in range(40)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`c {i}` double" for i in range(40))).repartition(7)
    plan = pearson(df, pdf.columns)
    got = {(r.col_a, r.col_b): r.r for r in plan.collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 1600 and got["c 7", "c 3"] is None and got["c 7", "c 7"] is None and got["c 11", "c 12"] is None
    for (a, b), r in got.items():
        if "c 7" not in (a, b) and r is not None:
            assert abs(r - want.loc[a, b]) < 1e-9
    n, sums, g = gram(df, ["c 0", "c 1", "c 2"])
    whole = pdf[["c 0", "c 1", "c 2"]].dropna().to_numpy()
    assert n == len(whole)
    np.testing.assert_allclose(sums, whole.sum(axis=0))
    np.testing.assert_allclose(g, whole.T @ whole)
    inverse = np.linalg.inv(g)
    for r in vif(df, ["c 0", "c 1", "c 2"]).collect():
        i = int(r.feature[2:])
        assert r.vif == pytest.approx(g[i, i] * inverse[i, i], rel=1e-3)  # columns far from zero: near singular


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {r.r for r in pearson(df, ["a", "b"]).collect()} == {None} and gram(df, ["a", "b"])[0] == 0


def test_ragged_rows_are_kept_apart(spark, tmp_path):
    wide = spark.createDataFrame([("1", "1/2/2020", None, 'say "x", y'), ("2", "", "7:00:00", "é")], "PtID string, date001 string, t string, note string")
    write_wide_csv(wide, str(tmp_path / "whole"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.csv").write_text('PtID,date001,t,note\n3,1/3/2020,8:00:00,fine\n4,only three,values\n5,a,b,c,one too many\n6,,,\n')
    rows, quarantine = read_wide_csv(spark, str(tmp_path / "whole"), str(tmp_path / "more"))
    got = sorted((r.PtID, r.date001, r.t, r.note) for r in rows.collect())
    assert got == [("1", "1/2/2020", None, 'say "x", y'), ("2", None, "7:00:00", "é"), ("3", "1/3/2020", "8:00:00", "fine"), ("6", None, None, None)]
    assert sorted(r.line for r in quarantine.collect()) == ["4,only three,values", "5,a,b,c,one too many"]
    assert rows.count() == 4 and quarantine.count() == 2 and rows.select("note").count() == 4
    assert {r.file.rsplit("/", 1)[1] for r in quarantine.select("file").collect()} == {"a.csv"}


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PtID,x\n1,2\n")
    (tmp_path / "b.csv").write_text("PtID,y\n1,2\n")
    rows, _ = read_wide_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    with pytest.raises(Exception, match="header"):
        rows.collect()
