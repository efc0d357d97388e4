"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
import oracle
from pipekit.queries import registry
from conftest import SF_DIR


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    assert oracle.differences(result, duck, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
