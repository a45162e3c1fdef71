"""Queries with SQL give its rows."""

import pytest

from dupforge.llm import registry

from ..conftest import DATA
from ..oracle import database, rows_of_duckdb, rows_of_spark


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_as_sql(spark, name):
    assert rows_of_spark(registry.queries()[name](spark, DATA)) == rows_of_duckdb(database(DATA).sql(registry.oracle_sql()[name]))


def test_all_ten_are_there():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))
