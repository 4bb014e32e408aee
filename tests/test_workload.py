"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from tools.compare import TABLES, canonical
from workload.oracles import all_oracles
from workload.queries import all_queries

pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, db, name):
    df = queries()[name](spark, SMOKE_DIR)
    answer = db.execute(oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(answer.fetchall(), columns)
    plain = {"bigint", "double", "string", "date", "boolean"}
    assert {f.dataType.simpleString() for f in df.schema} <= plain


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(all_queries()) == set(all_oracles()) and set(oracle_sql()) <= set(queries())
