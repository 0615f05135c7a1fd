"""Every query with SQL equals it on the smallest tables."""

import pytest

from sparkquill.plans import registry

from .oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SMALL, registry.queries()[name], registry.oracle_sql()[name]) == ""
