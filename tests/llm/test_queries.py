"""The queries of the subpackage on the smallest tables, with their SQL where they have any."""

import os

import pytest
from test_entry import SF, compare

from memloom.llm.queries import QUERIES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_equal_sql(spark, name):
    compare(spark, name)
