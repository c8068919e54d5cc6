import os

import __spark_entry__ as entry
import duckdb
import pytest

from tallyspark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    db = duckdb.connect()
    for table in "documents embeddings pages benchmark labels".split():
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    rows, expected = QUERIES[name](spark, DIR), db.sql(ORACLE_SQL[name])
    columns = sorted(rows.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(str(r[i]) for i in places) for r in expected.fetchall())


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) >= 11
