"""The operators' queries against their SQL on the smallest tables."""

import duckdb
import pytest

from storyloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    ours = QUERIES[name](spark, sf).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(theirs.fetchall(), key=repr)
