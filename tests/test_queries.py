"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_) else str(v)

    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    d.execute("set timezone = 'UTC'")
    for t in os.listdir(SF):
        d.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return d


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(sql).df()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries())
