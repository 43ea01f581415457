"""Every registered query with a SQL statement matches DuckDB at sf0.01."""

import pytest

from conftest import SF01
from signalspark.plans.check import compare
from signalspark.plans.oracle import ORACLE
from signalspark.plans.registry import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF01)
    assert r["match"], r
