"""Every query with expected-result SQL, on the smallest tables."""

import pytest

from checks.compare import connect, difference
from checks.queries import EXPECTED, QUERIES

from conftest import SMALLEST


@pytest.fixture(scope="module")
def connection():
    return connect(SMALLEST)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_same_result(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALLEST), connection, EXPECTED[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(EXPECTED)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALLEST).count() > 0
