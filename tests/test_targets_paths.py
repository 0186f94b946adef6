"""Target rules of single tasks, paths of any length, bucket search, skewed weights."""

import bisect
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.functions.buckets import bucket_of
from tidemark.operators import graph, labels, render, sampling
from tidemark.spec import DETAILED_LAYOUTS, INFO_KEYS


def test_task_targets_rules(spark):  # E5
    rows = [
        (1, 0, "transfers", 1, 10, {"careunit": "nan", "eventtype": "admit"}),
        (1, 0, "transfers", 2, 11, {"careunit": " ICU ", "eventtype": "transfer"}),
        (1, 1, "radiology", 3, 12, {"exam_name": '["CT", "MRI"]'}),
        (1, 1, "radiology", 4, 13, {"exam_name": '["CT"]'}),
        (1, 2, "discharge", 5, 14, {"text": " one note "}),
        (1, 3, "discharge", 6, 15, {"text": "a"}),
        (1, 3, "discharge", 7, 16, {"text": "b"}),
        (1, 4, "diagnoses_icd", 8, None, {"diagnoses": "flu", "CCS Type": "nan"}),
        (1, 5, "labevents", 9, 17, {}),
    ]
    df = spark.createDataFrame(rows, "subject_id long, event_idx long, file_name string, pos int, ts_us long, item map<string,string>")
    got = {(r["event_idx"], r["task"]): r["target"] for r in labels.task_targets(df).collect()}
    assert {k: v for k, v in got.items() if k[1] != "next_event"} == {
        (0, "transfers"): ["ICU", "admit"], (1, "radiology"): ["CT", "MRI"], (2, "discharge"): [" one note "],
        (4, "diagnoses_icd"): ["flu"]}
    assert got[(5, "next_event")] == ["labevents"] and (4, "next_event") not in got


ITEM = "subject_id long, event_idx long, file_name string, pos int, ts_us long, item map<string,string>"


def test_every_configured_kind_renders(spark):  # E7, E8
    assert set(INFO_KEYS) == set(DETAILED_LAYOUTS) == set(labels.CONFIGURED_KINDS) and len(INFO_KEYS) == 28
    rows = [(1, i, k, n, 0, {f: f"{f}{n}" for f in keys}) for i, (k, keys) in enumerate(INFO_KEYS.items()) for n in (1, 2)]
    df = spark.createDataFrame(rows, ITEM)
    texts = {r["file_name"]: r["text"] for r in render.render_events(df, render.record_specs()).collect()}
    for k, keys in INFO_KEYS.items():
        assert texts[k].startswith("## ") and all(f"{f}{n}" in texts[k] for f in keys for n in (1, 2)), k
    detailed = {r["file_name"]: r["text"] for r in render.render_detailed(df).collect()}
    assert all(t.startswith("## ") for t in detailed.values()) and len(detailed) == 28
    assert {k for k, t in detailed.items() if "\n" not in t} == {"edstays", "icustays"}


def test_fields_as_columns_render_like_a_map(spark):  # E7, E8: no map of all fields is made for a row that shows a few of them
    from pyspark.sql import functions as F
    fields = sorted({f for keys in INFO_KEYS.values() for f in keys})
    kinds = [*INFO_KEYS, "drgcodes"]
    rows = [(1, i, k, n, n if n % 2 else None, i + n) for i, k in enumerate(kinds) for n in range(1, 1 + i % 4)]
    df = spark.createDataFrame(rows, "subject_id long, event_idx long, file_name string, pos int, ts_us long, x int")
    cols = {f: F.when((F.col("x") + i) % 5 == 0, F.lit(None)).when((F.col("x") + i) % 5 == 1, F.lit("nan")).otherwise(F.concat(F.lit(f), F.col("x").cast("string")))
            for i, f in enumerate(fields)} | {"exam_name": F.to_json(F.array(F.lit("a"), F.col("x").cast("string")))}
    whole = df.withColumn("item", F.create_map(*(x for k, v in cols.items() for x in (F.lit(k), v))))
    for by_map, by_column in ((render.render_events(whole, render.record_specs()), render.render_events(df, render.record_specs(cols.__getitem__))),
                              (render.render_detailed(whole), render.render_detailed(df, item_col=cols.__getitem__))):
        got = sorted(map(tuple, by_column.collect()))
        assert got == sorted(map(tuple, by_map.collect())) and len(got) == len({r[1] for r in rows})
    texts = {(r["event_idx"]): r["text"] for r in render.render_events(df, render.record_specs(cols.__getitem__)).collect()}
    at = kinds.index("icustays")  # a kind without fields
    assert texts[at] == "## ICUstays [1970-01-01 00:00:00]\n" + ("" if at % 4 == 1 else "|  |\n|  |" + "\n|  |" * (at % 4))


def test_detailed_rules(spark):  # E8
    rows = [
        (1, 0, "labevents", 1, 0, {"item_name": "Na", "valuenum": "nan"}),
        (1, 0, "labevents", 2, 0, {"item_name": "K", "valuenum": "4.1", "ref_range_lower": "3", "comments": "{flag}"}),
        (1, 1, "transfers", 1, None, {"careunit": "ICU", "eventtype": "x"}),
        (1, 1, "transfers", 2, None, {"careunit": "nan", "eventtype": "admit"}),
        (1, 2, "patients", 1, None, {"anchor_age": "52", "gender": "M"}),
        (1, 3, "admissions", 1, 0, {"admission_type": "EU", "admission_location": "ER", "admission_info": '{"Plan": "rest"}'}),
        (1, 4, "diagnosis", 1, 0, {"icd_title": "CHEST PAIN"}), (1, 4, "diagnosis", 2, 0, {"icd_title": "FEVER"}),
        (1, 5, "drgcodes", 1, None, {"x": "y"}),
    ]
    got = {r["event_idx"]: r["text"] for r in render.render_detailed(spark.createDataFrame(rows, ITEM)).collect()}
    at = "[1970-01-01 00:00:00]"
    rule = "| ------ | ------ | ------ | ------ | ------ | ------ |"
    assert got == {
        0: f"## Labotary Test Events {at}\n| Item Name | Value | Unit | Range | Flag | Comments |\n{rule}\n| K | 4.1 |  | 3- | normal | {{flag}} |",
        1: "## Transfers [None]\n- ICU\n\n- admit", 2: "## Patient Demographics\n- Age: 52\n- Gender: Male",
        3: f"## Admissions {at}\n- Admission Type: EU\n- Admission Location: ER- Plan: rest",
        4: f"## ED Diagnoses on International Classification of Diseases {at}\n- Chest pain \n- Fever", 5: ""}


def test_reasoning_requests_hold_the_record(spark):  # E20
    df = spark.createDataFrame([("the record {answer}", "list it", "flu", "a -> b"), ("r", "i", "x", None)], "c string, i string, a string, g string")
    for kind in ("graph", "nograph", "free"):
        first, second = [r[0] for r in df.select(render.full_reasoning_request(*(F.col(c) for c in "ciag"), kind)).collect()]
        assert all(x in first for x in ("the record {answer}", "list it", "flu")) and ("a -> b" in first) == (kind == "graph")
        assert (second is None) == (kind == "graph")


def test_reason_prompts_hold_the_whole_record(spark):  # E20
    from tidemark.plans import catalog
    q = catalog.queries()
    size = {(r["subject_id"], r["event_idx"], r["task"]): r["input_len"] for r in q["e_context_text"](spark, SF_SMALL).collect()}
    prompts = q["e_reason_prompt"](spark, SF_SMALL).collect()
    assert {r["kind"] for r in prompts} == {"graph", "nograph", "free"} and any(size.values())
    assert all(r["prompt_len"] > size[r["subject_id"], r["event_idx"], r["task"]] for r in prompts)  # they held the task's name and the answer only


def test_reason_filter_ratios_on_both_sides(spark):  # G16
    from tidemark.plans import q_scoring
    kept = [r["kept"] for r in q_scoring.g_reason_filter_partial(spark, SF_SMALL).collect()]
    assert 0.2 < sum(kept) / len(kept) < 0.8


def test_paths_of_any_length(spark):  # F9
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)] + [("x", "y"), ("y", None), ("x", "x")], "a string, b string")
    pairs = spark.createDataFrame([("n0", "n7"), ("n2", "n2"), ("n0", "x"), ("n0", "gone"), ("n5", "n3"), (None, "x"), ("gone", "gone"), ("n0", "n7")],
                                  "src string, dst string")
    got = [tuple(r) for r in graph.shortest_paths(pairs, edges).select("src", "dst", "hops", "path").collect()]
    assert sorted(got, key=str) == sorted([("n0", "n7", 7, [f"n{i}" for i in range(8)])] * 2 + [("n2", "n2", 0, ["n2"]), ("n0", "x", None, None), ("n0", "gone", None, None),
                                          ("n5", "n3", 2, ["n5", "n4", "n3"]), (None, "x", None, None), ("gone", "gone", 0, ["gone"])], key=str)
    short = {(r["src"], r["dst"]): r["hops"] for r in graph.shortest_paths(pairs, edges, max_hops=3).collect()}
    assert short[("n0", "n7")] is None and short[("n5", "n3")] == 2


def test_paths_of_a_random_graph(spark):  # length, every edge and the tie rule
    rng = random.Random(5)
    names = [f"{rng.choice('abc')}{i}" for i in range(40)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(55)}
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} - {n} for n in names}
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(80)]

    def brute(src, dst):
        layer = [[src]]
        seen = {src}
        while layer:
            ends = [p for p in layer if p[-1] == dst]
            if ends:
                return min(ends)
            layer = [p + [n] for p in layer for n in near[p[-1]] if n not in seen]
            seen |= {p[-1] for p in layer}

    got = graph.shortest_paths(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(sorted(edges), "a string, b string")).collect()
    assert len(got) == len(pairs)
    for r in got:
        want = brute(r.src, r.dst) if near[r.src] or r.src == r.dst else None
        assert r.path == want and r.hops == (len(want) - 1 if want else None)


def test_evidence_record(spark):  # F11
    from tidemark.operators import concepts
    samples = spark.createDataFrame([(1, i, "t") for i in range(4)], "subject_id long, event_idx long, task string")
    rel = spark.createDataFrame([(1, 0, "t", "b", "x", 9.0, 1), (1, 0, "t", "b", "y", 8.0, 2), (1, 0, "t", "a", "z", 6.0, 1), (1, 1, "t", "q", "r", 7.0, 1)],
                                "subject_id long, event_idx long, task string, target_concept string, history_concept string, lift double, rank int")
    paths = spark.createDataFrame([("b", "y", 1, ["b", "y"]), ("z", "a", 2, ["z", "m", "a"]), ("b", "x", None, None), ("q", "s", 1, ["q", "s"])],
                                  "src string, dst string, hops int, path array<string>")
    got = {r.event_idx: r.evidence and r.evidence.asDict(True) for r in concepts.sample_evidence(samples, rel, paths).collect()}
    assert got == {0: {"related": [{"target": "a", "history": "z", "lift": 6.0}, {"target": "b", "history": "x", "lift": 9.0}, {"target": "b", "history": "y", "lift": 8.0}],
                       "paths": [["b", "y"], ["z", "m", "a"]]}, 1: None, 2: None, 3: None}


def test_bucket_of_counts_the_bounds_below(spark):
    rng = random.Random(3)
    bounds = sorted(rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()]) for _ in range(15))
    values = [rng.random() for _ in range(200)] + bounds
    df = spark.createDataFrame([(v, bounds) for v in values], "v double, bounds array<double>")
    assert all(r["b"] == bisect.bisect_left(bounds, r["v"]) for r in df.select("v", bucket_of("v", "bounds", 16).alias("b")).collect())


def test_weighted_sample_of_a_hot_label(spark):  # D11: nine rows in ten have one weight
    df = (spark.range(5000).select(F.col("id").alias("subject_id"), F.lit(0).cast("long").alias("event_idx"), F.lit("t").alias("task"),
                                   F.when(F.col("id") % 10 == 0, 1.0).otherwise(1 / 4500).alias("target_weight")))
    quota = spark.createDataFrame([("t", 700)], "task string, n_take long")
    got = sampling.sample_weighted(df, quota)
    scored = df.withColumn("_s", sampling.weighted_score(sampling.uniform(42, *sampling.SAMPLE_KEY), F.col("target_weight")))
    want = scored.orderBy("_s", "subject_id").limit(700).select("subject_id")
    assert {r[0] for r in got.select("subject_id").collect()} == {r[0] for r in want.collect()}
