import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.limits import Limits  # noqa: E402
from plumbline.session import local_session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"

# Few buckets, so that a search on a small table takes several passes.
DISTRIBUTED = Limits(buckets=16)


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def limits():
    return DISTRIBUTED


@pytest.fixture
def frame(spark):
    def build(schema: str, *rows):
        values = [row if isinstance(row, tuple) else (row,) for row in rows]
        return spark.createDataFrame(values, schema)

    return build
