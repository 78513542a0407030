"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.compare import differences, duck
from vestigia.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    assert differences(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set()
