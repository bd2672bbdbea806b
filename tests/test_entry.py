"""The driver's contract, and the catalogue against SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from ionloom.plans import all_oracles, all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    if name not in all_oracles():
        return
    rel = duck.sql(all_oracles()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([row[i] for i in at]) for row in rel.fetchall())
