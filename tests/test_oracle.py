import pytest
from compare import connect, same

from larkspur.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() >= 0
