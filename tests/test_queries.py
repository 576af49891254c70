"""Every query that has SQL gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from logspar import queries


def same(spark, sf_dir, query, sql):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, wanted = query(spark, sf_dir), db.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    order = lambda rows, names: sorted([tuple(repr(r[names.index(c)]) for c in columns) for r in rows])
    assert order([tuple(r) for r in got.collect()], got.columns) == order(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
