"""The operators' queries against their SQL twins, on the whole tables of the smallest scale."""

import pytest
from conftest import DATA
from test_queries import rows_of

from quarry.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = duck.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, out.fetchall())
