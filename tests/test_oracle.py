"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
