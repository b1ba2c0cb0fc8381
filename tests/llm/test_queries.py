"""Registered queries with comparison SQL; every operator has its query."""

import pytest
from compare import compare, duck
from readweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.ORACLE[name]).df()) == "ok"


def test_names():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in queries.QUERIES
