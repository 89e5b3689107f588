"""Every query over the smallest tables, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from inkstone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    return SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = QUERIES[name](spark, folder)
    expected = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    key = sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*key).collect()))) == sorted(map(repr, expected.select(*key).fetchall()))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder).cache()
        assert kept.columns == columns and 0 < kept.count() <= n
        assert kept.schema == docs.schema or [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        docs, n = kept, kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}
    assert packed.columns == corpus_pipeline.run(spark, folder).columns
