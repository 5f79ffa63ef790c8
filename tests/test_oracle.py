"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import pytest

from conftest import SMALL
from compare import assert_same
from marlpit.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(name, spark, duck):
    assert_same(QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
