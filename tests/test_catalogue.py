"""Each query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from echolith.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def _key(row, columns):
    return tuple("null" if row[c] is None or (isinstance(row[c], float) and math.isnan(row[c])) else str(row[c]) for c in columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DIR)
    rows = [r.asDict() for r in got.collect()]
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    if name not in ORACLE_SQL:
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    cur = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(_key(r, sorted(columns)) for r in rows) == sorted(_key(r, sorted(columns)) for r in want)


def test_entry_without_pipeline():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
