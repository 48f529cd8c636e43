import pytest

from granary.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(same, name):
    same(queries.queries()[name], SQL[name])
