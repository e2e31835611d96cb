import pytest

from tests.oracle import connect, difference, spark_rows, sql_rows
from tokenloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, SF)), sql_rows(connect(SF), ORACLES[name])) == ""
