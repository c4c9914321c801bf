"""Results of one configuration leave those of the others as they are."""

import pytest
from pyspark.sql import functions as F

from dosewise.operators.results import read_results, write_results


def _rows(spark, n=4, **config):
    return spark.range(n).select(*[F.lit(v).alias(k) for k, v in config.items()], F.col("id").alias("run"), (F.col("id") / 7).alias("specificity"))


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "results")


def test_configurations_written_in_turn_all_read_back(spark, place):
    base = {"featureset": "day", "method": "RF", "n_lags": 3, "max_depth": 2, "tuned": False, "final": False}
    configs = [base, {**base, "featureset": "week"}, {**base, "method": "LR"}, {**base, "n_lags": 4}, {**base, "max_depth": 5}, {**base, "tuned": True}, {**base, "final": True}]
    for c in configs:
        write_results(_rows(spark, **c), place, "pred", csv=True)
    write_results(_rows(spark, 2, **configs[3]), place, "pred", csv=True)  # written again: replaced, the others stay
    back = read_results(spark, place, "pred")
    assert dict(back.dtypes)["n_lags"] == "int" and dict(back.dtypes)["tuned"] == "boolean" and dict(back.dtypes)["final"] == "boolean"
    counts = {tuple(r[k] for k in base): r["count"] for r in back.groupBy(*base).count().collect()}
    assert counts == {tuple(c.values()): 2 if c is configs[3] else 4 for c in configs}
    assert read_results(spark, place, "pred", final=True).count() == 4 and read_results(spark, place, "pred", final=False).count() == 22
    text = read_results(spark, place, "pred", csv=True)
    assert sorted(text.columns) == sorted(back.columns) and text.count() == back.count()
    same = text.select(*[F.col(c).cast(t).alias(c) for c, t in back.dtypes]).exceptAll(back)
    assert same.count() == 0


def test_kinds_and_missing_configuration(spark, place):
    write_results(_rows(spark, featureset="day", method="RF").withColumn("max_depth", F.lit(None).cast("int")), place, "pred")
    write_results(_rows(spark, featureset="day", method="RF", max_depth=2), place, "pred")
    write_results(_rows(spark, 3, featureset="day", method="RF").withColumn("feature", F.lit("x")), place, "attr")
    got = {r["max_depth"]: r["count"] for r in read_results(spark, place, "pred").groupBy("max_depth").count().collect()}
    assert got == {None: 4, 2: 4} and read_results(spark, place, "attr").count() == 3


def test_a_failed_write_leaves_the_earlier_rows(spark, place):
    write_results(_rows(spark, featureset="day", method="RF"), place, "pred")
    broken = _rows(spark, featureset="day", method="RF").withColumn("run", F.when(F.col("run") == 3, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("run")))
    with pytest.raises(Exception, match="lost"):
        write_results(broken, place, "pred")
    assert read_results(spark, place, "pred").count() == 4
