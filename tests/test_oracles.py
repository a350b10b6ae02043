"""Every registered query against its SQL on the smallest scale factor."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from tools_check import TYPES, canonical

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*columns).collect()])
    if name not in SQL:
        assert got
        return
    order = ", ".join(f'"{c}"' for c in columns)
    rel = duck.sql(f"SELECT {order} FROM ({SQL[name]})")
    assert [TYPES.get(dict(df.dtypes)[c], c) for c in columns] == list(map(str, rel.types))
    assert got == canonical(rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
