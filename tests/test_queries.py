"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from storylake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, FOLDER).toPandas()
    theirs = duck.sql(registry.oracles()[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert normal(ours, columns) == normal(theirs, columns)
