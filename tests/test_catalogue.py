"""Every query against its SQL oracle on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'"
        )
    return connection


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(set(driver.queries()) & set(driver.oracle_sql())))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, DATA)
    result = duck.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = normal(columns, result.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["source", "target", "label"] and df.count() > 0
