"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

from habitatq.catalog import oracle
from habitatq.catalog import queries as catalog

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.REGISTRY)


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_same_rows(spark, con, name):
    assert compare.compare(spark, con, name, catalog.as_callables()[name], SQL[name], FOLDER) is None
