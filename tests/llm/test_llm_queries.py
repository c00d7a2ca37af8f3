"""Registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import os

import duckdb
import pytest

from tidelag.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    result = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*result.columns)
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() > 0.5 * len(before)
    assert not any("@mail" in r.text for r in docs.collect())
