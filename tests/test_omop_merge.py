"""Latest and earliest rows as of a sample, against the samples' whole periods."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import omop, ordering


def tables(spark, seed, n_patients=4):
    rng = random.Random(seed)
    rows, samples = [], []
    for p in range(n_patients):
        n = 120 if p == 0 else rng.randrange(0, 25)  # one patient holds most rows
        rows += [(p, i, rng.choice("TU"), rng.choice("abcd"), f"{p}-{i}") for i in range(n)]
        for _ in range(60 if p == 0 else rng.randrange(0, 6)):
            b, e = rng.choice([0, 0, rng.randrange(0, n + 3)]), rng.randrange(-1, n + 2)
            samples.append((len(samples), p, b, e))
    samples.append((len(samples), 99, 0, 5))  # a patient without rows
    return rows, samples


@pytest.mark.parametrize("seed", [1, 2])
def test_state_as_of_samples(spark, seed):
    rows, samples = tables(spark, seed)
    r, s = omop.merge(spark.createDataFrame(rows, "patient_id int, pos long, omop_table string, name string, value string").repartition(3),
                      spark.createDataFrame(samples, "sample_id int, patient_id int, period_begin long, period_end long"))
    assert {(x.patient_id, x.pos): x.ended for x in r.collect()} == {
        (p, i): sum(q == p and max(e, -1) < i for _, q, _, e in samples) for p, i, *_ in rows}
    want_last, want_first = {}, {}
    for sid, p, b, e in samples:
        for q, i, t, n, v in rows:
            if p == q and b <= i <= e:
                want_last[sid, t, n] = v
                want_first.setdefault((sid, t, n), v)
    cols = ["sample_id", "omop_table", "name", "value"]
    for f, want in ((omop.latest, want_last), (omop.earliest, want_first)):
        got = f(r, s, ["omop_table", "name"]).select(*cols).collect()
        assert len(got) == len(want) and {tuple(x)[:3]: x.value for x in got} == want
    sl = omop.slice_rows(spark.createDataFrame([(*x, None, None, 0) for x in rows], "patient_id int, pos long, omop_table string, code string, value string, "
                                               "unit string, x string, start_us long"),
                         spark.createDataFrame(samples, "sample_id int, patient_id int, period_begin long, period_end long"))
    assert sorted(map(tuple, sl.select("sample_id", "value").collect())) == sorted((sid, v) for sid, p, b, e in samples for q, i, _, _, v in rows if p == q and b <= i <= e)


def test_slice_takes_the_columns_that_are_read(spark, monkeypatch):
    """Rows without values are sliced as well, in as many partitions as there are rows for."""
    monkeypatch.setattr(omop, "SLICE_ROWS", 5)
    rows, samples = tables(spark, 5)
    r = spark.createDataFrame([x[:3] for x in rows], "patient_id int, pos long, omop_table string")
    s = spark.createDataFrame(samples, "sample_id int, patient_id int, period_begin long, period_end long")
    sl = omop.slice_rows(r, s)
    assert set(sl.columns) == {"sample_id", "patient_id", "pos", "ord", "omop_table"}
    want = [(sid, i, i + 1, t) for sid, p, b, e in samples for q, i, t, *_ in rows if p == q and b <= i <= e]
    want += [(sid, i, i - 1000000, t) for sid, p, b, e in samples for q, i, t, *_ in rows if p == q and t == "person"]
    assert sorted(tuple(x) for x in sl.select("sample_id", "pos", "ord", "omop_table").collect()) == sorted(want)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(rows) // 5))
    assert f", {n}), REPARTITION_BY_NUM" in sl._jdf.queryExecution().toString()


def test_matched_rows_stay_near_the_result(spark):
    """Many samples, few items: what the interval join emits is the result, not samples x rows."""
    rows = [(1, i, "T", "ab"[i % 2], str(i)) for i in range(300)]
    samples = [(k, 1, 0, k) for k in range(300)]
    r, s = omop.merge(spark.createDataFrame(rows, "patient_id int, pos long, omop_table string, name string, value string"),
                      spark.createDataFrame(samples, "sample_id int, patient_id int, period_begin long, period_end long"))
    assert omop.latest(r, s, ["omop_table", "name"]).count() == 599
    assert omop.earliest(r, s, ["omop_table", "name"]).select(F.sum(F.col("pos"))).first()[0] == 299


def _joins_over(df, column):
    """How many joins stand above the leaf that holds ``column``."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    at = next(i for i in reversed(range(len(lines))) if "LogicalRDD" in lines[i] and column in lines[i])
    joins, d = 0, depth[at]
    for i in reversed(range(at)):
        if depth[i] < d:
            joins, d = joins + lines[i][depth[i]:].startswith("Join"), depth[i]
    return joins


def test_rows_meet_the_books_by_code_only(spark):
    """Descriptions are resolved in the book: rows are not joined by reference, which many of them lack."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(["A/1", "A/1", "B/2", "C/3", "D/4", None])], "marker long, code string")
    book = spark.createDataFrame([("A/1", "plain"), ("A/1", "again"), ("B/2", "CPT4/x/y"), ("C/3", "ICD10PCS/7"), ("D/4", "CPT4/ICD10PCS"), (None, "none")],
                                 "code string, description string")
    cpt4 = spark.createDataFrame([("x/y", "proc"), ("x/y", "proc two"), ("7", "no")], "code string, description string")
    pcs = spark.createDataFrame([("7", "pcs"), ("ICD10PCS", "no")], "code string, description string")
    out = omop.resolve_codes(rows, book, cpt4, pcs)
    assert _joins_over(out, "marker") == 1
    want = [(0, "again"), (0, "plain"), (1, "again"), (1, "plain"), (2, "proc"), (2, "proc two"), (3, "pcs"), (4, None), (5, None)]
    assert sorted(map(tuple, out.select("marker", "content").collect()), key=str) == sorted(want, key=str)


def _spread(spark, seed):
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 0, 1, 2, None]), k // rng.choice([1, 7]), k) for k in range(400)]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_heads_of_runs_over_partition_ends(spark, partitions):
    """One group holds half of the rows, and a run can be longer than a partition."""
    rows = [(g, r // 90, k) for g, r, k in _spread(spark, partitions)]
    df = spark.createDataFrame(rows, "g int, r int, k int")
    got = ordering.run_heads(df.repartition(3), ["g"], "r", [F.col("r"), F.col("k")], "k", partitions).collect()
    want, ahead = [], None
    for g in (None, 0, 1, 2):
        ahead = None
        for r in sorted({x[1] for x in rows if x[0] == g}):
            k = min(x[2] for x in rows if x[:2] == (g, r))
            want.append((g, r, k, ahead))
            ahead = k
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_running_sums_of_rows_that_are_not_written(spark, partitions):
    rows = _spread(spark, partitions)
    df = spark.createDataFrame(rows, "g int, r int, k int").repartition(3)
    found = ordering.running_sums(df, ["g"], [F.col("k")], {"odd": F.col("k") % 2 == 1, "total": F.col("r")}, F.col("k") % 5 == 0, partitions)
    assert sorted(map(tuple, found.select("g", "k", "odd", "total").collect()), key=str) == sorted(
        ((g, k, sum(h == g and j <= k and j % 2 for h, _, j in rows), sum(x for h, x, j in rows if h == g and j <= k)) for g, _, k in rows if k % 5 == 0), key=str)


def test_stages_of_a_query_are_compressed_files_and_go(spark):
    """Rows are kept as columns, once: what they were made of is deleted, with the shuffles behind it."""
    from conftest import SF_SMALL
    from tidemark.plans import q_omop
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    root = root.removeprefix("file:")
    there = {root: set(os.listdir(root)), os.path.dirname(root): set(os.listdir(os.path.dirname(root)))}
    rows, samples = q_omop.merged(spark, SF_SMALL, "value", where=omop.is_measurement())
    new = [f"{d}/{x}" for d, old in there.items() for x in set(os.listdir(d)) - old]
    assert len(new) == 1 and "stage-" in new[0]  # were five checkpoints of all rows
    assert rows.columns == ["patient_id", "pos", "omop_table", "code", "value", "ended", "begun", "n_samples"]
    assert {r[0] for r in rows.select("omop_table").distinct().collect()} == {"measurement"} and samples.count() == 1500


def context_of(rows, samples, content, names, sid):
    """The text of the samples with an id, from the rows of their periods."""
    groups, lines, persons = [], [], []
    for s, p, b, e in samples:
        if s != sid:
            continue
        mine = sorted((x for x in rows if x[0] == p and x[2] != "person" and b <= x[1] <= e), key=lambda x: x[1])
        seen, last = set(), {}
        for _, i, t, c, v, start in mine:
            if t not in seen:
                groups.append((start, t))
            seen.add(t)
            if "drug" in t and content.get(c) and (t, content[c]) not in seen:
                seen.add((t, content[c]))
                lines.append((t, i + 1, f"- {content[c]}"))
            if t == "measurement" and c in names and v is not None:
                last[t, c] = (t, i + 1, f"| {names[c]} | {v} | None | nan | nan | nan |")
        lines += last.values()
        for _, i, t, c, _, start in (x for x in rows if x[0] == p and x[2] == "person"):
            persons.append((i, start))
            lines += [("person", o, f"- {content.get(c)}") for o in ([i - 1000000, i + 1] if b <= i <= e else [i - 1000000])]
    if persons:
        groups.append((min(persons)[1], "person"))
    out = []
    for start, t in sorted(groups):
        body = "\n".join(x for _, _, x in sorted(x for x in lines if x[0] == t))
        title = f"## {t.title()} [1970-01-01 00:00:{start:02d}]"
        if t != "measurement":
            out.append(f"{title}\n{body}" if body else title)
        elif body:
            out.append(f"{title}\n{omop.MEASURE_HEADER}\n{body}")
    return "\n\n".join(out)


def test_contexts_are_made_where_their_lines_are(spark):
    """Texts of periods that begin anywhere, of busy patients and of samples that share an id; no line is shuffled for each of its samples."""
    rng = random.Random(4)
    rows, samples = [], []
    for p in range(5):
        n = 55 if p == 0 else rng.randrange(1, 12)
        rows += [(p, i, *(("person", "P") if i == 0 and p != 3 else (rng.choice(["drug_exposure", "measurement"]), rng.choice("ABCD"))), rng.choice([None, "1.0", "2.5"]), i)
                 for i in range(n)]
        for _ in range(50 if p == 0 else 4):
            samples.append((len(samples) // (1 if p else 2), p, rng.choice([0, 0, 3, 9]), rng.randrange(-1, n + 2)))
    samples = [(s, p, b, e) for s, p, b, e in samples] + [(900, 77, 0, 5), (901, 3, 400, 500)]
    r, s = omop.merge(spark.createDataFrame([(*x[:5], None, x[5] * 1000000) for x in rows], "patient_id int, pos long, omop_table string, code string, value string, unit string, "
                                            "start_us long"),
                      spark.createDataFrame(samples, "sample_id int, patient_id int, period_begin long, period_end long"))
    pair = "code string, description string"
    book = spark.createDataFrame([("A", "aa"), ("B", "bb"), ("C", "aa"), ("P", "pp")], pair)
    none = spark.createDataFrame([], pair)
    out = omop.omop_context(r, s, book, none, none, spark.createDataFrame([], "code string, item_name string"),
                            spark.createDataFrame([], "item_name string, ref_low string, ref_high string, ref_unit string"))
    content = {"A": "aa", "B": "bb", "C": "aa", "P": "pp"}
    names = {"A": "aa", "B": "bb"}  # codes of one name are one item
    rows = [(p, i, t, "A" if t == "measurement" and c == "C" else c, v, at) for p, i, t, c, v, at in rows]
    got = {x.sample_id: x.input for x in out.collect()}
    want = {sid: context_of(rows, samples, content, names, sid) for sid in {x[0] for x in samples}}
    assert got == {k: v for k, v in want.items() if v}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    ids = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Aggregate") and "sample_id" in line.split("],")[0]]
    assert len(ids) == 1  # the samples that share an id; each line of each sample was grouped by it
