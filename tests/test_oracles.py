"""Every query with reference SQL gives the SQL's rows, over whole tables."""

from __future__ import annotations

import pytest

from setloom import catalog
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df())


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_gives_rows_and_the_core_stands_alone(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
