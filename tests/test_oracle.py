"""Every bound query against its SQL; those without SQL must return rows of a fixed schema."""

from __future__ import annotations

import pytest
from conftest import MEDIUM

import oracle
from cohortlens.bindings import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(MEDIUM)


def test_bound_query(spark, duck, bound_query):
    fn = QUERIES[bound_query]
    if bound_query in ORACLES:
        assert oracle.compare(spark, duck, fn, ORACLES[bound_query], MEDIUM) is None
    else:
        df = fn(spark, MEDIUM)
        assert df.columns and df.count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
