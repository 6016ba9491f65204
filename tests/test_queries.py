"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: Dummies of both factors are too many for SQL; tests/test_models.py compares with a dense solve.
WITHOUT_SQL = {"absorb_supplier_customer"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None
