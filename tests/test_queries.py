"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import connect, explain_difference, rows

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "collection", "vec_id", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    rel = con.execute(SQL[name])
    assert explain_difference(got, rows([d[0] for d in rel.description], rel.fetchall())) == ""
