"""C and L family queries on the bound event timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us, hours_between, is_before, midnight_us
from tidemark.operators import labels as lb
from tidemark.plans import bindings as b
from tidemark.plans.oracle import ctes
from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.spec import TASKS, UNTIMED_KINDS

KEY = ["subject_id", "event_idx"]
INDEX_OUT = ["subject_id", "hadm_id", "task", "event", "event_idx", "context_begin", "context_end", "target",
             "admissions_id", "last_discharge_id"]


def _prepared(spark, sf):
    return b.task_index_parts(spark, sf)[0]


def _flat(df):
    return df.withColumn("target", F.array_join("target", "|")).select(*INDEX_OUT)


def _ctx_query(key, cols, where=None):
    sql_where = f" WHERE {where[1]}" if where else ""

    @query(key, ctes("o_prep") + f"SELECT subject_id, event_idx, {', '.join(cols)} FROM o_prep{sql_where}")
    def run(spark, sf):
        p = _prepared(spark, sf)
        if where:
            p = p.where(where[0])
        return p.select(*KEY, *cols)
    return run


_ctx_query("c_context_back", ["ctx_begin"])
_ctx_query("c_context_fwd", ["ctx_last", "ctx_last_us", "ctx_last_icu", "ctx_last_icu_us"])


@query("c_context_until", ctes("o_prep") + "SELECT subject_id, event_idx, ctx_until FROM o_prep WHERE file_name = 'edstays'")
def c_context_until(spark, sf):
    from tidemark.operators import context as cx
    return cx.context_until(_prepared(spark, sf), "edstays", "end_us", out="ctx_until").select(*KEY, "ctx_until")


_ctx_query("c_carry_time", ["t_back", "t_fwd"])
_ctx_query("c_next_of_kind", ["adm_next_same", "adm_next_same_us", "icu_next_same", "icu_next_same_us", "ed_next",
                              "ed_next_us", "adm_next", "adm_next_us"])
_ctx_query("c_last_in_visit", ["last_in_visit_us"])
_ctx_query("c_asof_admission", ["admissions_id"])
_ctx_query("c_asof_discharge", ["last_discharge_id"])


@query("c_hours_between", ctes("o_events") + """
SELECT subject_id, event_idx,
       round(coalesce((starttime_us - lag(starttime_us) OVER (PARTITION BY subject_id ORDER BY event_idx))
                      / 3600000000.0, 1e9), 6) AS gap_hours
FROM o_events""")
def c_hours_between(spark, sf):
    ev = b.events(spark, sf)
    prev = ev.select("subject_id", (F.col("event_idx") + 1).alias("event_idx"), F.col("starttime_us").alias("_prev"))
    j = ev.join(prev, KEY, "left")
    return j.select(*KEY, F.round(hours_between(F.col("_prev"), F.col("starttime_us")), 6).alias("gap_hours"))


@query("c_is_before", ctes("o_events") + """
SELECT a.subject_id, a.event_idx, a.starttime_us < b.starttime_us AS before_next,
       a.endtime_us < a.starttime_us // 86400000000 * 86400000000 AS before_midnight
FROM o_events a JOIN o_events b ON b.subject_id = a.subject_id AND b.event_idx = a.event_idx + 1""")
def c_is_before(spark, sf):
    ev = b.events(spark, sf).select(*KEY, "starttime_us", "endtime_us")
    nxt = ev.select("subject_id", (F.col("event_idx") - 1).alias("event_idx"), F.col("starttime_us").alias("_next"))
    return ev.join(nxt, KEY).select(*KEY, is_before(F.col("starttime_us"), F.col("_next")).alias("before_next"),
                                    is_before(F.col("endtime_us"), midnight_us(F.col("starttime_us"))).alias("before_midnight"))


@query("c_task_map", ctes("o_events") + f"""
SELECT m.task, count(*) AS n_events FROM o_events e JOIN (
  SELECT * FROM (VALUES ('admissions', 'admissions'), ('labevents', 'labevents'),
      ('diagnoses_icd', 'diagnoses_icd'), ('diagnoses_icd', 'diagnoses_ccs'), ('discharge', 'discharge'),
      ('edstays', 'ED_Hospitalization'), ('edstays', 'ED_Inpatient_Mortality'), ('edstays', 'ED_ICU_Tranfer_12hour'),
      ('edstays', 'ED_Reattendance_3day'), ('edstays', 'ED_Critical_Outcomes'),
      ('discharge', 'Readmission_30day'), ('discharge', 'Readmission_60day'),
      ('admissions', 'Inpatient_Mortality'), ('admissions', 'LengthOfStay_3day'), ('admissions', 'LengthOfStay_7day'),
      ('icustays', 'ICU_Mortality_1day'), ('icustays', 'ICU_Mortality_2day'), ('icustays', 'ICU_Mortality_3day'),
      ('icustays', 'ICU_Mortality_7day'), ('icustays', 'ICU_Mortality_14day'), ('icustays', 'ICU_Stay_7day'),
      ('icustays', 'ICU_Stay_14day'), ('icustays', 'ICU_Readmission')) v(file_name, task)
  UNION ALL
  SELECT k, 'next_event' FROM (VALUES {', '.join(f"('{k}')" for k in lb.CONFIGURED_KINDS)}) w(k)
) m USING (file_name)
GROUP BY m.task""")
def c_task_map(spark, sf):
    ev = b.events(spark, sf)
    m = F.broadcast(lb.task_event_map(spark))  # fixed 46-task table x 28 kinds: bounded
    return ev.join(m, "file_name").groupBy("task").agg(F.count(F.lit(1)).alias("n_events"))


@query("c_decision_targets", ctes("o_targets_rec") + "SELECT subject_id, event_idx, task, target FROM o_targets_rec")
def c_decision_targets(spark, sf):
    t = b.record_parts(spark, sf)[1]
    return t.select(*KEY, "task", F.array_join("target", "|").alias("target"))


# Every decision task on its own kind of event: an order's line items of one kind are an event,
# their fields come from the part.
_DECISION = [t for t in TASKS if t.task_type == "decision_making" and t.event != "any"]
_KINDS = sorted({t.event for t in _DECISION})


def _field_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_shipdate")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    at = (F.col("l_partkey") % len(_KINDS)).cast("int")
    main = F.when(F.col("l_discount") == 0, F.lit("nan")).otherwise(F.concat(F.lit(" "), "p_name"))
    item = b.record_fields(main, F.col("p_brand"), F.col("p_type"), F.when(F.col("l_returnflag") == "R", F.lit("nan")).otherwise(F.col("p_brand")))
    return li.join(o, "l_orderkey").join(p, "l_partkey").select(
        "subject_id", (F.col("l_orderkey").cast("bigint") * 100 + at).alias("event_idx"),
        F.get(F.array(*map(F.lit, _KINDS)), at).alias("file_name"), F.col("l_linenumber").alias("pos"),
        epoch_us("l_shipdate").alias("ts_us"), item.alias("item"))


@query("c_task_targets", f"""
WITH k(file_name, k_pos) AS (VALUES {", ".join(f"('{k}', {i})" for i, k in enumerate(_KINDS))}),
t(task, file_name, target_key) AS (VALUES {", ".join(f"('{t.task}', '{t.event}', '{t.target_key}')" for t in _DECISION)}),
r AS (SELECT o_custkey AS subject_id, CAST(o_orderkey AS BIGINT) * 100 + k_pos AS event_idx, file_name,
             CASE WHEN l_discount = 0 THEN 'nan' ELSE ' ' || p_name END AS main, p_brand, p_type, l_returnflag
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN k ON k_pos = l_partkey % {len(_KINDS)}),
v AS (SELECT subject_id, event_idx, task,
             unnest(CASE WHEN task = 'radiology' THEN [p_brand, p_type]
                         WHEN task = 'transfers' THEN [CASE WHEN l_returnflag = 'R' THEN p_type ELSE p_brand END]
                         WHEN target_key IN ('CCS Type', 'ATC Type') THEN [p_brand] ELSE [main] END) AS v FROM r JOIN t USING (file_name))
SELECT subject_id, event_idx, task, target FROM (
  SELECT subject_id, event_idx, task, CASE WHEN task <> 'discharge' THEN string_agg(DISTINCT trim(v), '|' ORDER BY trim(v))
                                           WHEN count(*) = 1 THEN min(v) END AS target
  FROM v WHERE v <> 'nan' GROUP BY subject_id, event_idx, task) WHERE target IS NOT NULL
UNION ALL
SELECT DISTINCT subject_id, event_idx, 'next_event', file_name FROM r
WHERE file_name NOT IN ({", ".join(f"'{k}'" for k in UNTIMED_KINDS)}) AND file_name IN ({", ".join(f"'{k}'" for k in lb.CONFIGURED_KINDS)})""")
def c_task_targets(spark, sf):
    return lb.task_targets(_field_rows(spark, sf)).select(*KEY, "task", F.array_join("target", "|").alias("target"))


@query("c_decision_samples", ctes("o_decision_rec") + "SELECT * FROM o_decision_rec WHERE task <> 'next_event'")
def c_decision_samples(spark, sf):
    p, t = b.record_parts(spark, sf)
    return _flat(lb.decision_samples(p, t, with_next_event=False))


@query("c_next_event", ctes("o_decision_rec") + "SELECT * FROM o_decision_rec WHERE task = 'next_event'")
def c_next_event(spark, sf):
    p, t = b.record_parts(spark, sf)
    return _flat(lb.decision_samples(p, t).where(F.col("task") == "next_event"))


@query("c_risk_samples", ctes("o_risk") + "SELECT * FROM o_risk")
def c_risk_samples(spark, sf):
    return _flat(lb.risk_samples(_prepared(spark, sf)))


@query("c_task_index", ctes("o_index_rec") + "SELECT * FROM o_index_rec")
def c_task_index(spark, sf):
    return _flat(b.record_index(spark, sf))


_LABEL_KEYS = {
    "l_ed_hosp": ["ED_Hospitalization"],
    "l_ed_mortality": ["ED_Inpatient_Mortality"],
    "l_ed_icu_12h": ["ED_ICU_Tranfer_12hour"],
    "l_ed_return_72h": ["ED_Reattendance_3day"],
    "l_ed_critical": ["ED_Critical_Outcomes"],
    "l_readmit": ["Readmission_30day", "Readmission_60day"],
    "l_inpatient_death": ["Inpatient_Mortality"],
    "l_los": ["LengthOfStay_3day", "LengthOfStay_7day"],
    "l_icu_death": [f"ICU_Mortality_{d}day" for d in (1, 2, 3, 7, 14)],
    "l_icu_stay": ["ICU_Stay_7day", "ICU_Stay_14day"],
    "l_icu_readmit": ["ICU_Readmission"],
}

_EXTRACTOR = {"ED": lb.ed_labels, "Re": lb.discharge_labels, "In": lb.admission_labels, "Le": lb.admission_labels,
              "IC": lb.icu_labels}


def _label_query(key, tasks):
    in_list = ", ".join(f"'{t}'" for t in tasks)

    @query(key, ctes("o_risk") + f"SELECT * FROM o_risk WHERE task IN ({in_list})")
    def run(spark, sf):
        extractor = _EXTRACTOR[tasks[0][:2]]
        return _flat(extractor(_prepared(spark, sf)).where(F.col("task").isin(*tasks)))
    return run


for _k, _t in _LABEL_KEYS.items():
    _label_query(_k, _t)
