import os

import oracle
import pytest

from tidelog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_same_rows_as_sql(spark, name):
    assert oracle.compare(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) is None
