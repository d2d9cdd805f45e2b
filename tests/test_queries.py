"""Every registered query next to its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from checks import all_queries
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
