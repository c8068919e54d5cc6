import os

import pytest

import __spark_entry__ as entry
from tallyspark.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def normal(value):
    return "~" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_give_what_their_sql_gives(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    assert entry.entry(spark).count() > 0
    for name, sql in ORACLE_SQL.items():
        rows = QUERIES[name](spark, DIR)
        columns = sorted(rows.columns)
        got = sorted(tuple(normal(r[c]) for c in columns) for r in rows.collect())
        result = db.sql(sql)
        places = [result.columns.index(c) for c in columns]
        assert len(result.columns) == len(columns), name
        assert got == sorted(tuple(normal(r[i]) for i in places) for r in result.fetchall()), name
