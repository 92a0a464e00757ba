"""The corpus queries against their SQL."""

import pytest
import sqlcheck

from lucidgraph.llm import queries


@pytest.mark.skipif(not sqlcheck.HERE, reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    assert sqlcheck.rows_of_query(spark, queries.QUERIES[name]) == sqlcheck.rows_of_sql(queries.SQL[name])


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
