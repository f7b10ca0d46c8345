"""The operators that SQL can express against their SQL, over whole tables."""

import compare
import pytest

from larder.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    assert compare.differences(frame, compare.connect(SF_DIR), queries.ORACLE_SQL[name]) == []


def test_one_query_for_each_operator():
    assert sorted(queries.QUERIES) == sorted(
        {next(q for q in queries.QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)} | {"pipeline"}
    )
