"""Queries next to their SQL twins, and the registration."""

import pytest
from oracle_check import compare, connect

from auditloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    problem = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)[0]
    assert problem is None, problem


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
