"""The clustered index against every distance: all neighbours are found, at any block, stretch and pivots."""

import numpy as np
import pytest

from tidemark.operators import similar

SCHEMA = "task string, item string, vector array<float>"


def rows_of(seed, n=300):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [("t%d" % (i % 2), "i%03d" % i, [float(np.float32(x)) for x in centres[rng.integers(5)] + 0.2 * rng.normal(size=6)]) for i in range(n)]
    rows += [("t0", "copy%02d" % i, rows[0][2]) for i in range(n // 3)]  # a third of a task's items are one vector
    return rows


def brute(rows, k, asked=None):
    v = {(t, i): np.floor(256 * np.array(x)) for t, i, x in rows}
    out = set()
    for (t, i), x in v.items():
        if asked is None or (t, i) in asked:
            near = sorted((int(((x - y) ** 2).sum()), j) for (u, j), y in v.items() if u == t and j != i)[:k]
            out |= {(t, i, j, d, r + 1) for r, (d, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("options", [{}, {"max_queries": 40, "stretch": 8}, {"n_pivots": 1, "k": 1}, {"sample_rows": 3, "k": 20}])
def test_all_neighbours_are_found(spark, options):
    rows = rows_of(1)
    got = similar.nearest_items(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows, options.get("k", 5))


def test_stated_queries_and_awkward_items(spark):
    rows = rows_of(2, 40)
    odd = [("t0", None, [0.0] * 6), ("t0", "null", None), ("t0", "part", [0.0, None, 0.0, 0.0, 0.0, 0.0]), ("t0", "nan", [float("nan")] * 6), rows[0]]
    asked = spark.createDataFrame([("t0", "i000"), ("t1", "i001"), ("t1", "gone"), ("t0", "i000")], "task string, item string")
    got = similar.nearest_items(spark.createDataFrame(rows + odd, SCHEMA), asked).collect()
    assert set(map(tuple, got)) == brute(rows, 5, {("t0", "i000"), ("t1", "i001")}) and len(got) == 10
    none = spark.createDataFrame([], SCHEMA)
    assert similar.nearest_items(none).count() == 0
