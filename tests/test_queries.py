import pytest
from oracle import same

import __spark_entry__ as entry
from verdikt.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    same(entry.queries()[name](spark, small), small, ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 200
