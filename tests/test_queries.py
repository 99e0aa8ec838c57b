"""Every registered query gives the rows its SQL twin gives."""

from pathlib import Path

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, con, name):
    problem, *_ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF_DIR)
    assert problem is None, problem


def test_entry(spark):
    assert {"system", "hourly_unique_users", "top_users"} <= set(entry(spark).columns)


def test_every_operator_of_the_inventory_is_registered():
    have = {name.split("_")[0] for name in queries()}
    want = {
        f"{letter}{i:02d}"
        for letter, n in zip("abcdefghijk", (11, 13, 3, 55, 4, 3, 2, 8, 7, 2, 11))
        for i in range(1, n + 1)
    }
    assert want <= have, sorted(want - have)
