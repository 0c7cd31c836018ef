"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

from compare import connect, differences
from fleetledger.plans.registry import registered

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not supplied")
REGISTERED = registered()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, db, name):
    query, sql = REGISTERED[name]
    assert sql, "every query has a counterpart"
    assert differences(spark, db, FOLDER, query, sql) is None
