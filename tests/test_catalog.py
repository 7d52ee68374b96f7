"""Every catalogue query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

from termloom.catalog import all_oracles, all_queries
from tests.oracle_check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, name):
    result = compare(spark, FOLDER, all_queries()[name], all_oracles().get(name))
    assert result.startswith(("same", "rows only")), result


def test_oracles_belong_to_queries():
    assert set(all_oracles()) <= set(all_queries())
