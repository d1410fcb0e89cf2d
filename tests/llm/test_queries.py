from collections import Counter

import duckdb
import pytest
from conftest import DATA

from sessionloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("stress_turns", "tool_families", "replay_records"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    theirs = con.sql(queries.ORACLES[name])
    assert theirs.columns == df.columns and Counter(map(tuple, theirs.fetchall())) == Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n.endswith("_found")])
def test_found_has_the_columns_and_rows(spark, name):
    columns = {"p3_found": 5, "p4_found": 3, "p5_found": 2, "p6_found": 2, "p9_found": 1}
    df = queries.QUERIES[name](spark, DATA)
    assert len(df.columns) == columns[name] and df.count() > 0 and df.distinct().count() == df.count()
