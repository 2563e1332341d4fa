"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__
from oracle import connect, difference

ORACLES = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tiny, duck, name):
    assert difference(QUERIES[name](spark, tiny), duck, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows_and_a_stable_schema(spark):
    made = __spark_entry__.entry(spark)
    assert made.count() > 0
    assert [f.name for f in made.schema] == [
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "futurereferraltargetfeature_futurereferralcount",
        "futurereferraltargetfeature_futurereferralscore",
        "futurereferraltargetfeature_futurereferralgaps",
    ]
