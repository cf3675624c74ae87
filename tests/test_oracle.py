"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from jobs import directory_inventory, motility_report

from cytoframe.plans import assorted, censoring, imaging, inventory, motility, raster, walk_model

JOBS = {"job1_directory_inventory": directory_inventory, "job2_motility_report": motility_report}
PLANS = (assorted, censoring, imaging, inventory, motility, raster, walk_model)
QUERIES = {n: q for p in PLANS for n, q in p.QUERIES.items()} | {n: getattr(j, n) for n, j in JOBS.items()}
SQL = {n: q for p in PLANS for n, q in p.ORACLE_SQL.items()} | {n: j.SQL for n, j in JOBS.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_return_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
