import os

import pytest

from strandwell.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, queries.queries()[name], queries.oracle_sql()[name], oracle.database())
