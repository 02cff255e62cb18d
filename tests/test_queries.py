"""Every core query against its SQL over the small tables; those without SQL must run and give rows."""

import pytest

from cairn import queries as core
from tests.conftest import DATA

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_adds_the_subpackage_only_if_it_is_there():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
