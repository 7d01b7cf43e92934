"""Registered queries of the subpackage against their DuckDB oracle at sf0.001."""

import pytest

from lakesmith.llm import queries as Q
from oracle_compare import compare, duck

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_queries()))
def test_matches_oracle(spark, name):
    r = compare(spark, DIR, name, Q.spark_queries()[name], Q.oracle_queries()[name], duck(DIR))
    assert r["status"] == "MATCH", r
