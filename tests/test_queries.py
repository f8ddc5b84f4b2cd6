"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import pytest

from loomgene.plans.catalog import ORACLE_SQL, QUERIES


def rows_of(found):
    return sorted(tuple(map(repr, row)) for row in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert rows_of(df.select(*columns).collect()) == rows_of(want.project(",".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
