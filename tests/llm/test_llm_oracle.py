import pytest
from compare import connect, same

from larkspur.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])
