"""Every SQL-expressible query against DuckDB on the same tables."""

import os

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def _key(row):
    return tuple((x is None, str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    found = duck.sql(ORACLE[name])
    names = list(found.columns)
    expected = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(_key(tuple(r[c] for c in order)) for r in rows)
    theirs = sorted(_key(tuple(r[names.index(c)] for c in order)) for r in expected)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"kmeans_auto", "dbscan", "recommend_cf"}))
def test_runs(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).collect()


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "tidemark.llm" or name.startswith("tidemark.llm."):
            raise ModuleNotFoundError(name, name="tidemark.llm")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", missing)
    assert set(importlib.reload(entry).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
