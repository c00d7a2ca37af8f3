"""Every registered query of the reference operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidelag.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.5f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    result = duck.sql(plans.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(result.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(v) for v in r) for r in result.select(*columns).fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", ["panel_ols_forward", "eigenvalues", "permutation_pvalue", "null_histogram", "format_edges"])
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).columns
