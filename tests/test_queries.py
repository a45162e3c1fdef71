"""Every query that has SQL gives the SQL's rows; the others give rows."""

import pytest

from dupforge.plans.queries import ORACLES, QUERIES

from .conftest import DATA
from .oracle import database, rows_of_duckdb, rows_of_spark


@pytest.fixture(scope="module")
def db():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, db, name):
    assert rows_of_spark(QUERIES[name](spark, DATA)) == rows_of_duckdb(db.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLES}))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert {*e.oracle_sql()} <= {*e.queries()}
    assert e.entry(spark).count() == 1
