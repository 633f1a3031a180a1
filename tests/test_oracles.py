"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
import oracles
import workload
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(workload.queries()) == set(oracles.oracle_sql())
    assert set(workload.queries()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(workload.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SMALL) == ""


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["file_path", "chain_a", "chain_b", "all_atoms_count",
                                                 "interaction_type"]
