"""The corpus queries that have SQL against it, on the driver's tables."""

import os

import pytest

from copysift.llm import queries as Q
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(spark, Q.queries()[name], Q.oracle_sql()[name]) >= 1


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in Q.queries()] == list(range(1, 14))
