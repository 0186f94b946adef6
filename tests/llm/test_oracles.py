"""The queries that SQL can express, against their DuckDB twins at sf0.001."""

import pytest

from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, "/root/testdata/sf0.001")
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    want = [tuple(dict(zip(names, r))[c] for c in df.columns) for r in result.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
