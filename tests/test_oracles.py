"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import importlib
import os
import sys

import duckdb
import pytest

from tessera import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, DATA)
    theirs = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, mine.collect()) == rows(names, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sample", "feature", "bin"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_training_data_queries(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # its import raises
    with pytest.warns(UserWarning, match="left out"):
        assert set(importlib.reload(__spark_entry__).queries()) == set(queries.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
