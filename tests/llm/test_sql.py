"""Queries that SQL can express, against their SQL on the smallest tables; registration."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare_sql import compare
from ledgerlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = compare(entry.queries()[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).df())
    assert got.startswith("ok"), got


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
