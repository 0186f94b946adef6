"""Scans, configs and sinks on small files in a scratch folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tidemark.sources import ingest, sinks


def _scratch():
    return tempfile.mkdtemp(prefix="tidemark-src-")


def test_scan_events_csv_cleans_missing_texts(spark):  # A1
    d = _scratch()
    path = os.path.join(d, "labevents.csv")
    with open(path, "w") as fh:
        fh.write("subject_id,hadm_id,charttime,value\n1,22841357.0,2150-01-01 10:00:00,nan\n1,,2150-01-01,7.5\n")
    df = ingest.scan_events(spark, path, "labevents",
                            "subject_id long, hadm_id string, charttime string, value string")
    rows = sorted(df.collect(), key=lambda r: r["charttime"])
    assert [r["file_name"] for r in rows] == ["labevents", "labevents"]
    assert rows[1]["value"] is None and rows[0]["value"] == "7.5"


def test_select_and_unify_sources(spark):  # A2, A3
    a = spark.createDataFrame([(1, "x")], "subject_id long, a string")
    b = spark.createDataFrame([(2, 3.0)], "subject_id long, b double")
    dim = spark.createDataFrame([("k", "v")], "code string, title string")
    kept = ingest.select_event_tables({"a": a, "b": b, "d_items": dim}, exclude=("b",))
    assert set(kept) == {"a"}
    u = ingest.unify_sources({"hosp": a, "icu": b}, {"hosp": 0, "icu": 3})
    assert sorted(u.columns) == ["a", "b", "source_rank", "subject_id"] and u.count() == 2


def test_sample_list_and_config(spark):  # A13, A14
    d = _scratch()
    csv = os.path.join(d, "samples.csv")
    with open(csv, "w") as fh:
        fh.write("subject_id,task\n1,labevents\n")
    jl = os.path.join(d, "samples.jsonl")
    with open(jl, "w") as fh:
        fh.write(json.dumps({"subject_id": 1, "task": "labevents"}) + "\n")
    assert ingest.read_sample_list(spark, csv).count() == 1
    assert ingest.read_sample_list(spark, jl).count() == 1
    cfg = os.path.join(d, "cfg.json")
    with open(cfg, "w") as fh:
        json.dump({"labevents": 10, "ED_Hospitalization": -1}, fh)
    got = {r["task"]: r["quota"] for r in ingest.read_sample_config(spark, cfg).collect()}
    assert got == {"labevents": 10, "ED_Hospitalization": -1}


def test_sinks_write_partitioned_outputs(spark):  # A4, A15, A22
    d = _scratch()
    idx = spark.createDataFrame([(1, "labevents", 0), (2, "admissions", 1), (1, "admissions", 2)],
                                "subject_id long, task string, n long")
    sinks.write_task_index(idx, os.path.join(d, "by_task"))
    assert sorted(os.listdir(os.path.join(d, "by_task")))[0].startswith("_") or \
        any(x.startswith("task=") for x in os.listdir(os.path.join(d, "by_task")))
    back = spark.read.parquet(os.path.join(d, "by_task"))
    assert back.count() == 3 and "task" in back.columns
    sinks.write_by_patient(idx, os.path.join(d, "by_patient"))
    assert spark.read.parquet(os.path.join(d, "by_patient")).count() == 3
    summary = sinks.write_scored_log(idx.withColumn("score", F.lit(1.0)), os.path.join(d, "log"))
    sinks.write_scored_log(idx.withColumn("score", F.lit(0.0)), os.path.join(d, "log"))
    assert spark.read.json(os.path.join(d, "log")).count() == 6
    assert {r["task"]: r["n_scored"] for r in summary.collect()} == {"labevents": 1, "admissions": 2}


def test_subjects_are_read_from_their_buckets(spark):  # A4, A5, A6
    from pyspark.sql import types as T
    from tidemark.sources.sinks import subject_bucket
    d = os.path.join(_scratch(), "store")
    hot = spark.range(0, 60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("long").alias("subject_id"),
                                        F.col("id").alias("event_idx"), F.array(F.create_map(F.lit("k"), F.sha2(F.col("id").cast("string"), 256))).alias("items"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        sinks.write_trajectory(hot.repartition(8), d, buckets=16)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    number = spark.range(1).select(F.lit(7).cast("long").alias("s")).select(subject_bucket("s", 16)).first()[0]
    files = [f for f in os.listdir(os.path.join(d, "buckets=16", f"bucket={number}")) if f.endswith(".parquet")]
    assert len(files) > 1  # the hot subject was written by several tasks
    asked = spark.createDataFrame([(7,), (8,), (None,), (123456,)], "subject_id int")
    got = ingest.read_trajectory(spark, d, asked)
    assert got.columns == ["subject_id", "event_idx", "items"] and got.schema["subject_id"].dataType == T.LongType()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files_read = got.select(F.input_file_name()).distinct().count()
    assert files_read <= len(files) + 1 < spark.read.parquet(d).select(F.input_file_name()).distinct().count()
    assert got.groupBy("subject_id").count().orderBy("subject_id").collect() == hot.where("subject_id in (7, 8)").groupBy("subject_id").count().orderBy("subject_id").collect()
    assert got.select(F.col("items")[0]["k"]).distinct().count() == got.count()
    assert ingest.read_subjects(spark, d, asked.limit(0)).count() == 0
    assert ingest.read_subjects(spark, d).count() == 60_000


def test_case_table_bad_rows(spark):  # A21
    d = _scratch()
    fields = ["c", "h", "line one\nline two"]
    ok = {"lab_tests": "{'5': 'no', '50868': '16 mEq/L', '5': 'it\\'s'}", "range_lower": "{'50868': 8.0, '5': nan, '6': None}", "range_upper": "{'50868': 20}", "microbiology": "nan",
          "radiology": "[{'exam_name': 'CT', 'report': 'a, \"b\"\\nc'}]", "diagnoses": "['flu', None]"}
    rows = [("1", *fields, *ok.values())]
    for i, (c, v) in enumerate((("lab_tests", "{'a': "), ("range_lower", "{'a': 'high'}"), ("radiology", "no list"), ("microbiology", "{'1': 'growth'}"), ("diagnoses", ""))):
        rows.append((str(i + 2), *fields, *(ok | {c: v}).values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*ingest.CASE_FIELDS, *ingest.CASE_COLUMNS)))
    df.write.option("header", True).option("escape", '"').csv(f"{d}/csv")
    df.write.json(f"{d}/json")
    with open(f"{d}/json/part-broken.json", "w") as fh:
        fh.write("{broken\n")
    for fmt in ("csv", "json"):
        good, bad = ingest.scan_case_table(spark, f"{d}/{fmt}", fmt)
        got = {r.case_id: r for r in good.collect()}
        assert set(got) == {"1", "5", "6"}
        one = got["1"]
        assert one.lab_tests == {"50868": "16 mEq/L", "5": "it's"} and one.range_lower == {"50868": 8.0, "5": None, "6": None} and one.range_upper == {"50868": 20.0}
        assert one.microbiology is None and one.radiology[0].report == 'a, "b"\nc' and one.diagnoses == ["flu", None] and "\n" in one.exam
        assert got["5"].microbiology == {"1": "growth"} and got["6"].diagnoses is None
        faults = {r.case_id: r.bad for r in bad.collect()}
        want = {"2": ["lab_tests"], "3": ["range_lower"], "4": ["radiology"]}
        assert faults == (want if fmt == "csv" else want | {None: ["record"]})


def test_case_table_texts_are_parsed_once(spark):  # A21
    d = _scratch()
    spark.createDataFrame([("1", *"abc", *["{}"] * 4, "[]", "[]")], ", ".join(f"{c} string" for c in (*ingest.CASE_FIELDS, *ingest.CASE_COLUMNS))).write.json(f"{d}/json")
    for df in ingest.scan_case_table(spark, f"{d}/json", "json"):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == len(ingest.CASE_COLUMNS)


def test_code_books_keep_codes_as_text(spark):  # A7-A11
    from tidemark.sources import dimensions as dm
    d = _scratch()
    with open(f"{d}/icd.csv", "w") as fh:
        fh.write('icd_code,icd_version,long_title\n0010,9,"Cholera, ""classic"""\n0010,10,Other\n0010,9,Cholera\n,9,no code\nA1,10,nan\n')
    got = {(r.icd_version, r.icd_code): r.long_title for r in dm.load_icd_dim(spark, f"{d}/icd.csv").collect()}
    assert got == {("9", "0010"): "Cholera", ("10", "0010"): "Other", ("10", "A1"): None}
    with open(f"{d}/atc.jsonl", "w") as fh:
        fh.write('{"ndc_code": "00012345678", "atc_name": "first"}\n{"ndc_code": "00012345678", "atc_name": "last"}\n{"ndc_code": "7"}\n')
    assert {r.ndc_code: r.atc_name for r in dm.load_atc_dim(spark, f"{d}/atc.jsonl", "json").collect()} == {"00012345678": "last", "7": None}
    with open(f"{d}/rad.csv", "w") as fh:
        fh.write("note_id,subject_id,field_name,field_value,field_ordinal\nn1,1,exam_name,CT,1\nn1,1,exam_name,CT,2\nn1,1,exam_code,C7,1\nn1,1,exam_name,AB,3\nn2,1,exam_name,,1\n")
    assert {r.note_id: r["values"] for r in dm.load_radiology_dim(spark, f"{d}/rad.csv").collect()} == {"n1": ["AB", "CT"]}
