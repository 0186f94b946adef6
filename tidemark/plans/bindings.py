"""Hospital-shaped inputs derived from the given tables.

Role mapping (fixed, in one place):

* ``events`` rows are raw records of one subject (``user_id``);
  purchase -> admissions, error -> edstays, click -> icustays,
  view -> labevents, signup -> discharge note (visit NULL).
* visit (``hadm_id``) = user_id * 100 + whole weeks since 2024-01-01.
* durations come from ``value``: admissions last ``value`` hours,
  ICU stays ``value`` hours, ED stays ``value`` * 10 minutes.
* each admission row also yields one untimed ``diagnoses_icd`` row (code = props.k,
  ICD version 10 when value > 50 else 9) and, when value > 100, one ``drgcodes`` row.
* one ``patients`` row per subject; date of death = midnight of the subject's last
  record when that record is an ED or ICU stay.
* lab item names come from ``part`` (itemid = props.k -> p_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.joins import lookup
from tidemark.functions.time import epoch_us, midnight_us
from tidemark.sources.tables import table

KIND_OF = {"purchase": "admissions", "error": "edstays", "click": "icustays",
           "view": "labevents", "signup": "discharge"}
SOURCE_OF = {"admissions": 0, "labevents": 0, "diagnoses_icd": 0, "drgcodes": 0, "patients": 0,
             "discharge": 1, "edstays": 2, "icustays": 3}
EPOCH_2024_US = 1704067200000000
WEEK_US = 7 * 86400 * 1000000
HOUR_US = 3600 * 1000000
ED_MINUTES_PER_VALUE = 10

ROW_COLUMNS = ["subject_id", "row_id", "file_name", "source_rank", "ts_us", "hadm_id", "end_us",
               "dod_us", "k", "value", "target_text", "icd_version", "icd_code"]


def _map(col, mapping: dict):
    expr = None
    for key, val in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(val)) if expr is None else expr.when(col == F.lit(key), F.lit(val)))
    return expr


def raw_rows(spark: SparkSession, sf_dir: str, titles: DataFrame | None = None) -> DataFrame:
    """A1-A3 on the test tables: every record tagged with its kind, unioned by name. With ``titles`` (see :func:`icd_dim`)
    the coded rows, and they alone, look up their ``long_title`` before the union."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    kind = _map(F.col("event_type"), KIND_OF)
    us = epoch_us("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    base = (ev.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("row_id"),
        kind.alias("file_name"),
        us.alias("ts_us"),
        F.when(F.col("event_type") != "signup",
               F.col("user_id") * 100 + F.floor((us - F.lit(EPOCH_2024_US)) / F.lit(WEEK_US))).alias("hadm_id"),
        F.col("value"), k.alias("k"), F.col("event_type")))
    end = (F.when(F.col("file_name").isin("admissions", "icustays"),
                  F.col("ts_us") + F.floor(F.col("value") * F.lit(float(HOUR_US))))
           .when(F.col("file_name") == "edstays",
                 F.col("ts_us") + F.floor(F.col("value") * F.lit(float(ED_MINUTES_PER_VALUE * 60 * 1000000)))))
    text = (F.when(F.col("file_name") == "admissions",
                   F.when(F.col("k") <= 33, F.lit("EMERGENCY")).when(F.col("k") <= 66, F.lit("URGENT"))
                   .otherwise(F.lit("ELECTIVE")))
            .when(F.col("file_name") == "discharge", F.concat(F.lit("discharge note "), F.col("k").cast("string"))))
    records = base.select(
        "subject_id", "row_id", "file_name", F.lit(None).cast("int").alias("source_rank"), "ts_us", "hadm_id",
        end.alias("end_us"), F.lit(None).cast("bigint").alias("dod_us"), "k", "value",
        text.alias("target_text"), F.lit(None).cast("string").alias("icd_version"),
        F.lit(None).cast("string").alias("icd_code"))
    adm = base.where(F.col("event_type") == "purchase")
    diagnoses = adm.select(
        "subject_id", "row_id", F.lit("diagnoses_icd").alias("file_name"), F.lit(None).cast("int").alias("source_rank"),
        F.lit(None).cast("bigint").alias("ts_us"), "hadm_id", F.lit(None).cast("bigint").alias("end_us"),
        F.lit(None).cast("bigint").alias("dod_us"), "k", "value", F.lit(None).cast("string").alias("target_text"),
        F.when(F.col("value") > 50, F.lit("10")).otherwise(F.lit("9")).alias("icd_version"),
        F.col("k").cast("string").alias("icd_code"))
    drg = adm.where(F.col("value") > 100).select(
        "subject_id", "row_id", F.lit("drgcodes").alias("file_name"), F.lit(None).cast("int").alias("source_rank"),
        F.lit(None).cast("bigint").alias("ts_us"), "hadm_id", F.lit(None).cast("bigint").alias("end_us"),
        F.lit(None).cast("bigint").alias("dod_us"), "k", "value", F.lit(None).cast("string").alias("target_text"),
        F.lit(None).cast("string").alias("icd_version"), F.lit(None).cast("string").alias("icd_code"))
    last = (base.groupBy("subject_id")
            .agg(F.max_by(F.struct("file_name", "ts_us"), F.col("ts_us")).alias("_last")))
    patients = last.select(
        "subject_id", F.lit(-1).cast("bigint").alias("row_id"), F.lit("patients").alias("file_name"),
        F.lit(None).cast("int").alias("source_rank"), F.lit(None).cast("bigint").alias("ts_us"),
        F.lit(None).cast("bigint").alias("hadm_id"), F.lit(None).cast("bigint").alias("end_us"),
        F.when(F.col("_last.file_name").isin("edstays", "icustays"), midnight_us(F.col("_last.ts_us"))).alias("dod_us"),
        F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("string").alias("target_text"), F.lit(None).cast("string").alias("icd_version"),
        F.lit(None).cast("string").alias("icd_code"))
    if titles is not None:  # no other row has a code: behind the union all of them would go to the join, under a null key
        diagnoses = lookup(diagnoses, titles, on=["icd_version", "icd_code"])
    rows = records
    for more in (diagnoses, drg, patients):
        rows = rows.unionByName(more, allowMissingColumns=titles is not None)
    return rows.withColumn("source_rank", _map(F.col("file_name"), SOURCE_OF))


def lab_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10-shaped dimension: itemid -> label."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"),
                                               F.col("p_name").alias("item_label"))


def icd_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7-shaped dimension: (icd_version, icd_code) -> long_title, codes as text."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    v9 = p.select(F.lit("9").alias("icd_version"), F.col("p_partkey").cast("string").alias("icd_code"),
                  F.concat_ws(" ", F.lit("condition"), F.col("p_name")).alias("long_title"))
    v10 = p.select(F.lit("10").alias("icd_version"), F.col("p_partkey").cast("string").alias("icd_code"),
                   F.concat_ws(" ", F.lit("disorder"), F.lower(F.col("p_type"))).alias("long_title"))
    return v9.unionByName(v10)


def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their decision-target text resolved through the dimensions."""
    rows = raw_rows(spark, sf_dir, icd_dim(spark, sf_dir))
    rows = lookup(rows, lab_items(spark, sf_dir), on="k")
    target = (F.when(F.col("file_name") == "labevents", F.col("item_label"))
              .when(F.col("file_name") == "diagnoses_icd", F.col("long_title"))
              .otherwise(F.col("target_text")))
    return rows.withColumn("target_text", target).drop("item_label", "long_title")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5-B8 on the bound rows: every row with its position ``pos``."""
    from tidemark.operators.timeline import order_timeline
    return order_timeline(decoded_rows(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table (one row per run) with first-row payload."""
    from tidemark.operators.timeline import eventize
    return eventize(marked_rows(spark, sf_dir), extra_first=("end_us", "dod_us"), marked=True)


def stay_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """ED/ICU-shaped rows from ``orders`` (stays) and ``lineitem`` (sub rows).

    stay = order; subject = customer; visit = customer * 10000 + order year.
    Lineitems: return flag R -> diagnosis (untimed), line status O -> pyxis,
    otherwise vitalsign; their time is the ship date. Stay outtime = latest ship date.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"),
        epoch_us("o_orderdate").alias("intime_us"),
        (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("hadm_id"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), "l_linenumber", "l_partkey", "l_suppkey",
        epoch_us("l_shipdate").alias("ship_us"), "l_returnflag", "l_linestatus")
    out = li.groupBy("stay_id").agg(F.max("ship_us").alias("outtime_us"))
    stays = o.join(out, "stay_id", "left")
    sub = li.join(o.select("stay_id", "subject_id", "hadm_id"), "stay_id").select(
        "subject_id", "hadm_id", "stay_id",
        F.when(F.col("l_returnflag") == "R", F.lit("diagnosis"))
         .when(F.col("l_linestatus") == "O", F.lit("pyxis")).otherwise(F.lit("vitalsign")).alias("file_name"),
        F.when(F.col("l_returnflag") != "R", F.col("ship_us")).alias("ts_us"),
        "l_linenumber", "l_partkey", "l_suppkey")
    heads = o.select("subject_id", "hadm_id", "stay_id", F.lit("edstays").alias("file_name"),
                     F.col("intime_us").alias("ts_us"), F.lit(0).alias("l_linenumber"),
                     F.lit(0).cast("bigint").alias("l_partkey"), F.lit(0).cast("bigint").alias("l_suppkey"))
    triage = heads.withColumn("file_name", F.lit("triage")).withColumn("ts_us", F.lit(None).cast("bigint"))
    return heads.unionByName(triage).unionByName(sub), stays


# Decision tasks whose target key the bound rows carry (in ``target_text``).
BOUND_TASKS = ("admissions", "labevents", "diagnoses_icd", "discharge")


def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with position and event id (written by the ordering: a stage boundary)."""
    from tidemark.operators.timeline import order_and_mark
    return order_and_mark(decoded_rows(spark, sf_dir))


def task_index_parts(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None,
                     max_events: int | None = None):
    """(prepared events, per-event targets) for the C/L/D queries.

    Stage boundaries are materialized: the run-marked row table (read by both the
    event aggregation and the target extraction) and the prepared event table
    (read by the five extractors)."""
    from tidemark.operators import labels as lb
    from tidemark.operators.timeline import event_count_filter, eventize
    marked = marked if marked is not None else marked_rows(spark, sf_dir)
    ev = eventize(marked, extra_first=("end_us", "dod_us"), marked=True)
    if max_events is not None:  # B15 is a choice of the caller, not a bound of the plan
        ev = event_count_filter(ev, 1, max_events)
    prepared = lb.prepare(ev)
    targets = lb.extract_targets(marked, lb.task_event_map(spark), BOUND_TASKS)
    return prepared, targets


def task_index(spark: SparkSession, sf_dir: str, marked: DataFrame | None = None) -> DataFrame:
    from tidemark.operators import labels as lb
    from tidemark.session import materialize
    prepared, targets = task_index_parts(spark, sf_dir, marked)
    return materialize(lb.task_index(prepared, targets))


#: Kinds that the ``view`` records are dealt to, by k: with the other records, every kind that has a decision task.
RECORD_KINDS = ("labevents", "omr", "procedures_icd", "microbiologyevents", "services", "transfers", "emar", "poe", "prescriptions", "radiology",
                "medrecon", "pyxis", "diagnosis", "chartevents", "ingredientevents", "datetimeevents", "procedureevents", "inputevents", "outputevents")
RECORD_SOURCE = {"radiology": 1, "medrecon": 2, "pyxis": 2, "diagnosis": 2} | {k: 3 for k in RECORD_KINDS[13:]}


def record_fields(main, brand, kind_of_part, careunit) -> Column:
    """A record's fields as a map, by name: every target key of the decision tasks."""
    from tidemark.spec import TASKS
    keys = sorted({t.target_key for t in TASKS if t.task_type == "decision_making" and t.event != "any"})
    own = {"CCS Type": brand, "ATC Type": brand, "exam_name": F.to_json(F.array(brand, kind_of_part)), "eventtype": kind_of_part}
    return F.create_map(*(x for k in keys for x in (F.lit(k), own.get(k, main))), F.lit("careunit"), careunit)


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every kind with a decision task, each with what its record is made of (see :func:`with_record`)."""
    rows = decoded_rows(spark, sf_dir)
    kind = F.when(F.col("file_name") == "labevents", F.get(F.array(*map(F.lit, RECORD_KINDS)), F.col("k") % len(RECORD_KINDS))).otherwise(F.col("file_name"))
    rows = rows.withColumn("file_name", kind)
    rows = rows.withColumn("source_rank", F.coalesce(_map(F.col("file_name"), RECORD_SOURCE), "source_rank"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), "p_name", "p_brand", "p_type")
    return rows.join(part, "k", "left")


def with_record(rows: DataFrame) -> DataFrame:
    """Rows of :func:`record_rows` with their record ``item`` (map of field texts) in place of what it is made of. The map is
    a hundred times as long as that, so it is made where fields are read, behind all ordering."""
    main = F.when(F.col("value") < 10, F.lit("nan")).otherwise(F.concat(F.lit(" "), "p_name"))
    unit = F.when(F.col("value") > 100, F.lit("nan")).otherwise(F.col("p_brand"))
    return rows.withColumn("item", record_fields(main, F.col("p_brand"), F.col("p_type"), unit)).drop("p_name", "p_brand", "p_type")


def record_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(prepared events, targets) on the rows of every kind: the records go through ordering and runs, and each decision task
    reads its own target key from them."""
    from tidemark.operators import labels as lb
    from tidemark.operators.timeline import eventize, order_and_mark
    marked = order_and_mark(record_rows(spark, sf_dir))
    prepared = lb.prepare(eventize(marked, extra_first=("end_us", "dod_us"), marked=True))
    targets = lb.task_targets(with_record(marked).select("subject_id", "event_idx", "file_name", "pos", "ts_us", "item"))
    return prepared, targets.where(F.col("task") != "next_event")  # next events are sampled from the events themselves


def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 over all 46 tasks."""
    from tidemark.operators import labels as lb
    from tidemark.session import materialize
    return materialize(lb.task_index(*record_parts(spark, sf_dir)))


class Pipeline:
    """The staged pipeline of one query: each stage built once, on first use. ``keep_targets``: the targets are
    written as well, for a query that reads them beside the index."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep_targets: bool = False):
        self.spark, self.sf_dir, self.keep_targets = spark, sf_dir, keep_targets
        self._marked = self._parts = self._targets = self._index = None

    @property
    def marked(self) -> DataFrame:
        if self._marked is None:
            self._marked = marked_rows(self.spark, self.sf_dir)
        return self._marked

    @property
    def prepared(self) -> DataFrame:
        return self._get_parts()[0]

    @property
    def targets(self) -> DataFrame:
        if self._targets is None:
            from tidemark.operators import labels as lb
            from tidemark.session import materialize
            found = lb.extract_targets(self.marked, lb.task_event_map(self.spark), BOUND_TASKS)
            self._targets = materialize(found) if self.keep_targets else found
        return self._targets

    def _get_parts(self):
        if self._parts is None:
            self._parts = task_index_parts(self.spark, self.sf_dir, self.marked)
        return self._parts

    @property
    def index(self) -> DataFrame:
        if self._index is None:
            from tidemark.operators import labels as lb
            from tidemark.session import materialize
            self._index = materialize(lb.task_index(self.prepared, self.targets))
        return self._index


def pipeline(spark: SparkSession, sf_dir: str, keep_targets: bool = False) -> Pipeline:
    return Pipeline(spark, sf_dir, keep_targets)
