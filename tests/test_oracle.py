"""Every SQL-checked query equals its DuckDB oracle on the smallest scale."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ("events", "customer", "nation", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def _names():
    from dosewise.plans.catalog import ORACLE
    return sorted(ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from tools.oracle_check import frame_digest

    spd = E.queries()[name](spark, SF_SMALL).toPandas()
    opd = duck.sql(E.oracle_sql()[name]).df()
    sc, sr, _ = frame_digest(spd)
    oc, orows, _ = frame_digest(opd)
    assert sc == oc
    assert len(sr) == len(orows)
    assert sr == orows


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["user_id", "study_week", "n_events", "adherence_rate", "adherent"]
    assert df.count() == 60
