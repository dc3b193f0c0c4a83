"""Every registered query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quern.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 5)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, small, oracle, name):
    df = catalogue.QUERIES[name](spark, small)
    want = oracle.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_task_is_delivered_or_dead(spark, small):
    got = catalogue.QUERIES["embed_batches"](spark, small).groupBy("status").count().collect()
    assert {r["status"] for r in got} <= {"DELIVERED", "DEAD"}
    assert sum(r["count"] for r in got) == spark.read.parquet(f"{small}/documents.parquet").count()
