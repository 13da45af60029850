"""Every registered query of the engine against its SQL."""

import os

import pytest

from copysift.plans import queries as Q
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name])  # asserts; some have no rows on the smallest tables


def test_every_query_has_sql():
    assert set(Q.queries()) == set(Q.oracle_sql())
