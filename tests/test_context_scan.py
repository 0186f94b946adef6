"""The two-level context scan: blocks of any size give what one block per subject gives, and no group outgrows a block."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import context as cx
from tidemark.plans import bindings as b
from conftest import SF_SMALL

H = 3_600_000_000
SCHEMA = "subject_id long, event_idx long, file_name string, hadm_id long, starttime_us long, end_us long, dod_us long"
KINDS = ["admissions", "edstays", "icustays", "labevents", "discharge", "diagnoses_icd"]


def timeline(seed, subjects=((1, 240), (2, 30), (3, 1), (4, 90))):
    """Subjects with crowded days, ties, visits that return, null visits and untimed events."""
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in subjects:
        t = 0
        rows.append((s, 0, "patients", None, None, None, int(rng.integers(0, 500)) * H if s % 2 else None))
        for i in range(1, n):
            kind = str(rng.choice(KINDS))
            t += int(rng.choice([0, 0, 1, 3, 23, 24, 60], p=[.3, .2, .2, .1, .08, .07, .05])) * H
            visit = None if kind == "discharge" or rng.random() < 0.1 else s * 100 + int(rng.integers(0, 4))
            untimed = kind == "diagnoses_icd" or rng.random() < 0.05
            rows.append((s, i, kind, visit, None if untimed else t, t + int(rng.integers(0, 80)) * H if kind in KINDS[:3] else None, None))
    return rows


def brute(rows):
    """(subject, event) -> the context columns, by looking at every other event of the subject."""
    out = {}
    for s in {r[0] for r in rows}:
        ev = sorted(r for r in rows if r[0] == s)
        dod = max((r[6] for r in ev if r[6] is not None), default=None)
        back = [ev[k - 1][4] if r[2] == "diagnoses_icd" and k else None if r[2] == "diagnoses_icd" else r[4] for k, r in enumerate(ev)]
        for k, (_, i, kind, visit, t, end, _) in enumerate(ev):
            later, same = ev[k + 1:], [r for r in ev[k + 1:] if visit is not None and r[3] == visit]
            begin = min((r[1] for r, u in zip(ev[:k], back) if r[1] >= 1 and r[3] == visit and None not in (u, back[k]) and back[k] - u < 24 * H), default=None)
            on = max((r[1] for r in later if t is not None and r[3] == visit and r[4] is not None and r[4] - t < 24 * H), default=None)
            first = lambda rs, x: next((r[1] for r in rs if r[2] == x), None)
            timed = [r[4] for r in same if r[4] is not None]
            asof = lambda x: next((r for r in reversed(ev[:k + 1]) if r[2] == x), None)
            adm, dis = asof("admissions"), asof("discharge")
            until = max((r[1] for r in later if kind == "edstays" and r[4] is not None and r[4] < end), default=None)
            out[s, i] = (dod, back[k], begin, on, on if visit is not None else None, first(same, "admissions"), first(same, "icustays"),
                         first(later, "edstays"), first(later, "admissions"), timed[-1] if timed else None,
                         adm[1] if adm and adm[3] is not None and adm[3] == visit else None,
                         dis[1] if dis and (visit is None or dis[3] is None or dis[3] != visit) else None, until)
    return out


COLUMNS = ["dod_us", "t_back", "ctx_begin", "ctx_last", "ctx_last_icu", "adm_next_same", "icu_next_same", "ed_next", "adm_next", "last_in_visit_us",
           "admissions_id", "last_discharge_id"]


def found(prepared):
    until = {(r.subject_id, r.event_idx): r.ctx_until for r in cx.context_until(prepared).collect()}
    return {(r.subject_id, r.event_idx): (*(r[c] for c in COLUMNS), until.get((r.subject_id, r.event_idx))) for r in prepared.collect()}


@pytest.mark.parametrize("seed,block", [(1, 4096), (1, 7), (2, 1), (3, 20), (4, 3)])
def test_blocks_against_every_pair(spark, seed, block):
    rows = timeline(seed)
    assert found(cx.with_context(spark.createDataFrame(rows, SCHEMA), block)) == brute(rows)


def test_hot_subject_equals_windows_and_is_spread(spark):
    """One subject with more than a third of all events: the same columns as in one block, from groups of one block at most."""
    ev = b.events(spark, SF_SMALL)
    ids = ev.select("subject_id").distinct().orderBy("subject_id").limit(1).first()[0]
    hot = ev.where(F.col("file_name") != "patients").withColumn("_s", F.col("subject_id"))
    w = Window.partitionBy("subject_id").orderBy(F.col("starttime_us").asc_nulls_first(), "_s", "event_idx")
    hot = (hot.withColumn("subject_id", F.when(F.col("_s") % 2 == 0, F.lit(ids)).otherwise(F.col("_s")))
           .withColumn("event_idx", F.row_number().over(w).cast("bigint")).drop("_s"))
    total = hot.count()
    assert hot.where(F.col("subject_id") == ids).count() > total / 3
    whole, cut = cx.with_context(hot, 1 << 40), cx.with_context(hot, 16)
    same = [c for c in whole.columns if c not in ("block", "far_until")]
    assert whole.select(same).exceptAll(cut.select(same)).count() == 0 == cut.select(same).exceptAll(whole.select(same)).count()
    assert cx.context_until(whole).select("subject_id", "event_idx", "ctx_until").exceptAll(
        cx.context_until(cut).select("subject_id", "event_idx", "ctx_until")).count() == 0
    assert cut.groupBy("subject_id", "block").count().agg(F.max("count")).first()[0] <= 16


def test_no_window_is_keyed_by_subject_alone(spark):
    """Every window over events is keyed by block or by partition; windows by subject see one row a block."""
    prepared = cx.with_context(spark.createDataFrame(timeline(1), SCHEMA), 8)
    plan = cx.context_until(prepared)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.split("\n"):
        if "Window [" in line:
            assert "block" in line, line


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_neighbours(spark, partitions):
    """One group holds half of the rows; neighbours are found over partition ends and gaps."""
    rng = np.random.default_rng(partitions)
    rows = [(int(rng.choice([0, 0, 1, 2])), k, int(k) if rng.random() < 0.1 else None) for k in range(400)]
    got = cx.neighbours(spark.createDataFrame(rows, "g int, k int, v int"), ["g"], [F.col("k")], F.col("v"), F.col("v"), partitions).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.g and x[2] is not None]
        assert r.prev == max((x[2] for x in mine if x[1] < r.k), default=None)
        assert r.next == min((x[2] for x in mine if x[1] > r.k), default=None)
    assert len(got) == len(rows)
