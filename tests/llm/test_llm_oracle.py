import pytest
from compare import connect, rows_of_spark, rows_of_sql

from conftest import MIDDLE
from emberline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, MIDDLE)) == rows_of_sql(connect(MIDDLE), queries.ORACLE[name])
