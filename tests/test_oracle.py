"""Every registered query gives what its SQL gives in another engine."""

import pytest
from oracle_check import compare, oracle_connection

import __spark_entry__ as contract
from ronda.plans.oracle import ORACLE
from ronda.plans.queries import all_queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(all_queries()) == set(ORACLE)


def test_contract_holds_all():
    assert set(all_queries()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_same_result(spark, duck, sf_dir, name):
    query, sql = all_queries()[name], ORACLE[name]
    assert compare(spark, duck, name, query, sql, sf_dir) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
