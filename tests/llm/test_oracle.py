"""Every query of the package runs over its whole tables; those with SQL equal it."""

import pytest

from strophe.llm.queries import QUERIES, SQL

from ..oracle import connect, rows


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got) > 0
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()
