"""Every query against the SQL that DuckDB runs over the same tables."""

import duckdb
import pytest

from edgeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    ours = registry.QUERIES[name](spark, data)
    theirs = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    expected = sorted(map(repr, theirs.fetchall()))
    found = sorted(repr(tuple(r)) for r in ours.select(*columns).collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
