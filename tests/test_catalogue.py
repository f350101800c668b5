"""Every query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest
from pareframe.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return bool(value) if type(value).__name__ in ("bool", "bool_") else value


def same_form(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    assert same_form(catalogue.queries()[name](spark, sf_dir).toPandas()) == same_form(duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).where("retained").count() >= 1
