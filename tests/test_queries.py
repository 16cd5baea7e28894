"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return f"{float(v):.9g}"
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    if name not in oracle_sql():
        assert len(got)
        return
    want = duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
