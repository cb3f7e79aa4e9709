"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from compare import connect, rows_of_spark, rows_of_sql

from conftest import MIDDLE
from emberline.plans import registry


@pytest.fixture(scope="module")
def duck():
    return connect(MIDDLE)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    assert rows_of_spark(registry.QUERIES[name](spark, MIDDLE)) == rows_of_sql(duck, registry.ORACLE[name])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLE if not n.startswith("st_")))
def test_same_types(spark, duck, name):
    got = {c: KINDS.get(t, t) for c, t in registry.QUERIES[name](spark, MIDDLE).dtypes}
    assert got == {r[0]: r[1] for r in duck.execute("DESCRIBE " + registry.ORACLE[name]).fetchall()}


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, MIDDLE).count() > 0
