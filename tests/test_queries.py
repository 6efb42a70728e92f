"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
import compare
from weirmark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    left = compare.spark_rows(entry.queries()[name](spark, SF))
    assert compare.difference(left, compare.duck_rows(duck, entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
