"""The registered queries of the subpackage that SQL can express, against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from spanloom.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_against_sql(spark, name):
    d = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        d.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda x: x[sorted(x.columns)].astype(object).where(x.notna(), "").astype(str).replace(r"\.0$", "", regex=True).sort_values(sorted(x.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(entries.queries()[name](spark, SF).toPandas()), plain(d.execute(entries.oracle_sql()[name]).df()))


def test_names():
    assert [n.split("_")[0] for n in entries.queries()] == [f"op{i}" for i in range(1, 11)]
