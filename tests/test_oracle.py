"""Every registered query against its DuckDB twin (the driver's gate, at sf0.001)."""

import hashlib
import math

import pytest

from tidemark.plans import catalog
from conftest import SF_SMALL

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert df.columns  # rows-only query: it runs and has a schema
        return
    res = duck.execute(ORACLES[key])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {d[0]: str(d[1]) for d in res.description}
    assert spark_types == duck_types
    assert len(rows) == len(drows)
    assert _digest(rows, df.columns) == _digest(drows, dcols)
