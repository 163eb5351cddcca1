"""Every query of the library against its SQL twin, value by value."""

import math

import pytest
from conftest import DATA

from quarry.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    out = duck.execute(SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, out.fetchall())
