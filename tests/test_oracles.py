"""Every query of the core that has a SQL form, against DuckDB on the test tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from sessionloom.plans import MODULES

CORE = {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((str(k), plain(x)) for k, x in v.items()))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(duck.sql(CORE[name]).columns) == columns
    ours = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    theirs = Counter(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({CORE[name]})").fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
