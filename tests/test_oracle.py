"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    assert check(spark, con, FOLDER, name) is None


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_returnflag", "quantity", "n"]
    assert entry.entry(spark).count() == 3
