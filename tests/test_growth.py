"""What must not grow faster than the input: work per row, rows of a shuffle, columns carried through an ordering."""

import random
import time
from collections import Counter

from tidemark.operators import scoring as so


def test_rouge1_of_long_texts_is_linear(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [(k, *(" ".join(rng.choices(words, k=n)) for n in sizes)) for k, sizes in enumerate([(3000, 3500), (1, 5), (7, 7), (4000, 10)])]
    rows = spark.createDataFrame(texts + [(4, "", "a b"), (5, "A a-a b", "a. a c"), (6, None, "a")], "id int, q string, a string")
    begun = time.time()
    found = {r["id"]: r for r in so.rouge1(rows, ["id"], "q", "a").collect()}
    assert time.time() - begun < 40  # tokens were made anew for each token of a text
    for k, q, a in texts + [(5, "a a a b", "a a c")]:
        n = sum((Counter(q.split()) & Counter(a.split())).values())
        assert abs(found[k]["precision"] - n / len(a.split())) < 1e-12 and abs(found[k]["recall"] - n / len(q.split())) < 1e-12
    assert found[4]["f1"] == 0 and found[6]["f1"] == 0


def test_records_are_made_behind_the_ordering(spark):
    from conftest import SF_SMALL
    from tidemark.plans import bindings as b
    rows = b.record_rows(spark, SF_SMALL)
    assert "item" not in rows.columns  # the map of a row's fields was sorted and written with it
    item = b.with_record(rows.where("file_name <> 'patients' and value > 100 and p_name is not null").withColumn("was", rows["p_name"])).select("item", "was").first()
    assert item["item"]["medication"] == " " + item["was"] and item["item"]["careunit"] == "nan"


def test_context_windows_keep_their_partitions(spark):
    from tidemark.operators import context as cx
    events = spark.createDataFrame([(s, i, k, s * 10, i * 10 ** 9, i * 10 ** 9 + 5, None) for s in range(40) for i, k in enumerate(["admissions", "labevents"])],
                                   "subject_id long, event_idx long, file_name string, hadm_id long, starttime_us long, end_us long, dod_us long")
    found = cx.with_context(events)
    # small partitions were put together, and one task sorted all of them for every window
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 80


def test_context_text_takes_columns_along(spark):
    from tidemark.operators import render as rd
    samples = spark.createDataFrame([(1, 2, "a", 1, 2, None, None, ["x", "y"]), (1, 2, "b", 1, 2, None, None, ["z"])],
                                    "subject_id long, event_idx long, task string, context_begin long, context_end long, last_discharge_id long, "
                                    "admissions_id long, target array<string>")
    texts = spark.createDataFrame([(1, 0, "patients", "P"), (1, 1, "labevents", "L")], "subject_id long, event_idx long, file_name string, text string")
    hidden = spark.createDataFrame([("a", []), ("b", ["labevents"])], "task string, bid_event array<string>")
    found = {r["task"]: r for r in rd.context_text(samples, texts, hidden, carry=("target",)).collect()}
    assert found["a"]["target"] == ["x", "y"] and found["a"]["input"] == "P\n\n\n\n\n\nL"
    assert found["b"]["target"] == ["z"] and found["b"]["input"] == "P\n\n\n\n"


def test_tasks_taken_whole_are_not_scored(spark, monkeypatch):
    from tidemark.operators import sampling as sm
    index = spark.createDataFrame([(s, 0, t, 1.0 if s % 2 else 3.0) for s in range(60) for t in ("all", "some")] + [(99, 0, "all", None)],
                                  "subject_id long, event_idx long, task string, target_weight double")
    quota = spark.createDataFrame([("all", None), ("some", 7)], "task string, n_take long")
    scored = []
    written = sm.materialize
    monkeypatch.setattr(sm, "materialize", lambda df: scored.append(written(df)) or scored[-1])
    found = sm.sample_weighted(index, quota).groupBy("task").count().collect()
    assert {r["task"]: r["count"] for r in found} == {"all": 61, "some": 7}
    assert {r["task"] for r in scored[-1].collect()} == {"some"}


def test_context_windows_share_their_sorts(spark, monkeypatch):
    from tidemark.operators import context as cx
    events = spark.createDataFrame([(1, i, "admissions", 7, i * 10 ** 9, i * 10 ** 9 + 5, None) for i in range(5)],
                                   "subject_id long, event_idx long, file_name string, hadm_id long, starttime_us long, end_us long, dod_us long")
    monkeypatch.setattr(cx, "materialize", lambda df: df)
    plan = cx.with_context(events)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window ") for line in plan.splitlines()) == 5  # seven, each with its own sort


def test_only_coded_rows_look_up_titles(spark):
    from conftest import SF_SMALL
    from tidemark.plans import bindings as b
    lines = b.decoded_rows(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    union = next(i for i, line in enumerate(lines) if "Union" in line)
    titles = [i for i, line in enumerate(lines) if "Join" in line and "icd_code" in line]
    assert titles and min(titles) > union  # every row went to the join of titles, most of them under a null key


def test_targets_read_beside_the_index_are_written(spark):
    from conftest import SF_SMALL
    from tidemark.plans import bindings as b
    pl = b.pipeline(spark, SF_SMALL, keep_targets=True)
    assert pl.targets is pl.targets and "Aggregate" not in pl.targets._jdf.queryExecution().optimizedPlan().toString()
    assert pl.targets.exceptAll(b.pipeline(spark, SF_SMALL).targets).isEmpty() and pl.targets.count()


def test_records_are_rendered_where_their_order_lies(spark):
    from conftest import SF_SMALL
    from tidemark.plans import q_render
    plan = q_render.e_render_kinds(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in plan]
    grouped = [i for i, x in enumerate(plan) if "ObjectHashAggregate(" in x]
    assert len(grouped) == 4
    above = [i for i, x in enumerate(plan) if "Exchange " in x and any(depth[i] < depth[g] and i < g for g in grouped)
             and not any(g < i and depth[g] < depth[i] for g in grouped)]
    assert not above and not any("Exchange hashpartitioning(subject_id" in x for x in plan)  # every rendered row was shuffled, for each style


def test_kinds_that_show_a_field(spark):
    """Where a field is left out, no text of the kind changes."""
    from tidemark.operators import render as rd
    from tidemark.spec import INFO_KEYS
    fields = sorted({f for keys in INFO_KEYS.values() for f in keys})
    record = {f: '["x"]' if f == "exam_name" else '{"a": "x"}' if f == "admission_info" else "x" for f in fields}
    rows = [(1, i, k, 1, 0, {g: v for g, v in record.items() if g != f}) for f in [None, *fields] for i, k in enumerate(INFO_KEYS)]
    rows = [(j // len(INFO_KEYS), *r[1:]) for j, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "subject_id long, event_idx long, file_name string, pos int, ts_us long, item map<string,string>")
    texts = [{(r["subject_id"], r["file_name"]): r["text"] for r in found.collect()} for found in (rd.render_events(df, rd.record_specs()), rd.render_detailed(df))]
    for n, f in enumerate(fields, 1):
        assert {k for t in texts for k in INFO_KEYS if t[n, k] != t[0, k]} <= {*rd.kinds_with(f)}, f
    assert {*rd.kinds_with("text")} == {"radiology", "discharge"} and "radiology" in rd.kinds_with("exam_name") and "admissions" in rd.kinds_with("admission_info")
