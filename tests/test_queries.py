"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from alignscope.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def rows(names, values, columns):
    order = [names.index(c) for c in columns]
    return sorted((tuple(r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert rows(df.columns, got, columns) == rows(names, cursor.fetchall(), columns)
