"""Registered queries against their SQL on the small tables (see compare.py)."""

import os

import pytest

from registered.oracle import ORACLE
from registered.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    from tests.compare import connect, differences

    n, m, left, right = differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name])
    assert n == m and not left and not right


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
