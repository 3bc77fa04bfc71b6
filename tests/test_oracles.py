"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pytest

from barloom import plans

from .conftest import SMALL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(str)
    return list(df.columns), sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = plans.queries()[name](spark, SMALL).toPandas()
    theirs = duck.execute(plans.oracle_sql()[name]).df()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
