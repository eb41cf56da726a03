import os

import pytest

from strandwell import catalog
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    oracle.same(spark, catalog.queries()[name], catalog.oracle_sql()[name], db)
