"""Registered queries of the operators against their check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, TABLES, table


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op") or n == "pipeline"])
def test_query_equals_its_check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cur.description], cur.fetchall())
