"""Interval joins against plain ranges, with a subject whose samples all look back over all its events."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import concepts, intervals, render


@pytest.mark.parametrize("width", [1, 4, 16])
def test_events_in_ranges(spark, width):
    rng = random.Random(width)
    events = [(s, i, f"v{s}-{i}") for s in range(3) for i in range(rng.randrange(1, 60)) if rng.random() < 0.8]
    ranges = [(s, k, *sorted((rng.randrange(-3, 70), rng.randrange(-3, 70)))) for k in range(60) for s in [rng.randrange(4)]]
    got = intervals.events_in(spark.createDataFrame(ranges, "subject_id int, k int, b long, e long"),
                              intervals.bucketed(spark.createDataFrame(events, "subject_id int, event_idx long, v string"), ["v"], width=width),
                              F.col("b"), F.col("e"), width=width).select("k", F.explode("found").alias("x")).select("k", "x.v").collect()
    assert sorted(map(tuple, got)) == sorted((k, v) for s, k, b, e in ranges for t, i, v in events if s == t and b <= i < e)


SAMPLES = "subject_id long, event_idx long, task string, context_begin long, context_end long, last_discharge_id long, admissions_id long"


def test_dense_subject(spark):
    """Every event of one subject looks back over all others: contexts and histories are those of plain ranges, texts move once a context."""
    n = 60
    kinds = ["admissions", "labevents", "discharge"]
    texts = [(1, i, "patients" if i == 0 else kinds[i % 3], f"text {i}") for i in range(n)]
    samples = [(1, i, t, 1, i, 2 if i > 5 else None, 3 if i % 2 else None) for i in range(2, n) for t in ("admissions", "labevents", "Readmission_30day")]
    samples += [(2, 0, "labevents", 0, 0, None, None), (1, 7, "next_event", 5, 5, None, None)]
    df = spark.createDataFrame(samples, SAMPLES)
    hidden = {"admissions": [], "labevents": [], "Readmission_30day": ["discharge"], "next_event": []}
    got = {tuple(r)[:3]: (r.input, r.n_context) for r in render.context_text(
        df, spark.createDataFrame(texts, "subject_id long, event_idx long, file_name string, text string"),
        spark.createDataFrame(list(hidden.items()), "task string, bid_event array<string>")).collect()}
    of = {(s, i): (k, t) for s, i, k, t in texts}
    want = {}
    for s, i, task, b, e, d, a in samples:
        ctx = [of[s, j][1] for j in range(b, e) if (s, j) in of and of[s, j][0] != "admissions" and of[s, j][0] not in hidden[task]]
        first = [of.get((s, x), ("", ""))[1] for x in (0, d, a if task != "admissions" else None)]
        want[s, i, task] = ("\n\n".join(first + ctx), len(ctx))
    assert got == want
    known = [(1, i, c) for i in range(n) for c in {f"c{i % 7}", f"c{i % 5}"}]
    found = concepts.history_concepts(df, spark.createDataFrame(known, "subject_id long, h_idx long, concept string")).collect()
    assert len(found) == len(set(found))
    assert set(map(tuple, found)) == {(s, i, t, c) for s, i, t, b, e, d, a in samples for u, j, c in known if s == u and (b <= j < e or j in (d, a))}
