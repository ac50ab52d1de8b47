"""The numbered queries against their DuckDB SQL on the same tables."""

import collections
import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.execute(f"create view {table.split('.')[0]} as select * from '{sf_dir}/{table}'")
    df = QUERIES[name](spark, sf_dir)
    found = con.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(df.columns)
    mine = collections.Counter(tuple(str(r[c]) for c in found.columns) for r in df.collect())
    assert mine == collections.Counter(tuple(map(str, r)) for r in found.fetchall())
