"""Every registered query with comparison SQL, at the smallest scale."""

import __spark_entry__ as entry
import pytest
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches(spark, con, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
