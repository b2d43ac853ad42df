"""Every query of the core runs over its whole tables; those with SQL equal it."""

import pytest

from strophe.catalog import collect

from .oracle import connect, rows

QUERIES, SQL = collect()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
