"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    note, _, _, good = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert good, note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() == 4
