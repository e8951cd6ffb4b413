"""Registered queries against their oracle on the smallest tables."""

import glob

import duckdb
import numpy as np
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = oracle.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns, key=lambda x: (got[x].dtype != object, x))
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for x in columns:
        if got[x].dtype.kind == "f" or want[x].dtype.kind == "f":
            np.testing.assert_allclose(got[x].astype(float), want[x].astype(float), rtol=1e-9, atol=2e-6, err_msg=x)
        else:
            assert (got[x].astype(str) == want[x].astype(str)).all(), x


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
