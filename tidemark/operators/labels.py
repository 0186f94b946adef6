"""Task mapping, decision samples, risk labels, task index.

One pass of context columns over the event table (see ``operators.context``), then each
extractor is a filter + projection; the 18 yes/no labels are unpivoted with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import US_PER_HOUR
from tidemark.operators import context as cx
from tidemark.spec import EVENT_DISPLAY_NAMES, TASKS, UNTIMED_KINDS, TaskSpec, task_frame

# Kinds with a registered converter ("any" expands to these; drg/hcpcs are disabled).
CONFIGURED_KINDS = tuple(k for k in EVENT_DISPLAY_NAMES if k not in ("hcpcsevents", "drgcodes"))

SAMPLE_COLS = ["subject_id", "hadm_id", "task", "event", "event_idx", "context_begin", "context_end", "target"]


def _lt_hours(a, b, hours: float):
    """(b - a) < hours on exact micros; a NULL side is 'far' -> False."""
    return F.coalesce((b - a) < F.lit(int(hours * US_PER_HOUR)), F.lit(False))


def _yn(cond):
    return F.when(cond, F.lit("yes")).otherwise(F.lit("no"))


def task_event_map(spark, tasks: list[TaskSpec] | None = None, kinds=CONFIGURED_KINDS) -> DataFrame:
    """C11: (event kind, task, task_type); 'any' expands to every configured kind.
    Fixed-size (tasks x kinds), safe to broadcast."""
    tf = task_frame(spark, tasks or TASKS)
    any_kinds = F.array(*[F.lit(k) for k in kinds])
    return tf.select(F.explode(F.when(F.col("event") == "any", any_kinds).otherwise(F.array("event"))).alias("file_name"),
                     "task", "task_type", "target_key", "metric")


def prepare(events: DataFrame, block_events: int = cx.BLOCK_EVENTS) -> DataFrame:
    """All columns the extractors need (C1-C8), computed once and written; see :func:`context.with_context`."""
    return cx.with_context(events, block_events)


def _unpivot(df: DataFrame, labels: dict[str, object], begin, end) -> DataFrame:
    stack = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), c.alias("y")) for t, c in labels.items()]))
    out = df.select("subject_id", "hadm_id", F.col("file_name").alias("event"), "event_idx",
                    begin.alias("context_begin"), end.alias("context_end"),
                    "admissions_id", "last_discharge_id", stack.alias("_l"))
    return (out.where(F.col("_l.y").isNotNull())
            .select("subject_id", "hadm_id", F.col("_l.task").alias("task"), "event", "event_idx", "context_begin",
                    "context_end", F.array(F.col("_l.y")).alias("target"), "admissions_id", "last_discharge_id"))


def ed_labels(prepared: DataFrame) -> DataFrame:
    """L1-L5 for ED stays (context = the stay through the last event before ED out)."""
    e = cx.context_until(prepared, "edstays", "end_us", out="ctx_until")
    e = e.where(F.col("ctx_until").isNotNull())
    out, dod = F.col("end_us"), F.col("dod_us")
    mort = dod.isNotNull() & F.col("last_in_visit_us").isNotNull() & ~(F.col("last_in_visit_us") < dod)
    icu12 = F.col("icu_next_same").isNotNull() & _lt_hours(out, F.col("icu_next_same_us"), 12)
    labels = {
        "ED_Hospitalization": _yn(F.col("adm_next_same").isNotNull()),
        "ED_Inpatient_Mortality": _yn(mort),
        "ED_ICU_Tranfer_12hour": _yn(icu12),
        "ED_Reattendance_3day": _yn(F.col("ed_next").isNotNull() & _lt_hours(out, F.col("ed_next_us"), 72)),
        "ED_Critical_Outcomes": _yn(icu12 | mort),
    }
    return _unpivot(e, labels, F.col("event_idx"), F.col("ctx_until") + 1)


def admission_labels(prepared: DataFrame) -> DataFrame:
    """L8-L10 (length of stay only when the context ends before discharge)."""
    e = prepared.where((F.col("file_name") == "admissions") & F.col("ctx_last").isNotNull())
    adm, dis, dod = F.col("t_fwd"), F.col("end_us"), F.col("dod_us")
    los_ok = F.col("ctx_last_us") < dis
    stay = dis - adm
    labels = {
        "LengthOfStay_3day": F.when(los_ok, _yn(stay > F.lit(72 * US_PER_HOUR))),
        "LengthOfStay_7day": F.when(los_ok, _yn(stay > F.lit(168 * US_PER_HOUR))),
        "Inpatient_Mortality": _yn(dod.isNotNull() & ~(dis < dod)),
    }
    return _unpivot(e, labels, F.col("event_idx"), F.col("ctx_last") + 1)


def icu_labels(prepared: DataFrame) -> DataFrame:
    """L11-L18 (context: same non-NULL visit, < 24 h after ICU in)."""
    e = prepared.where((F.col("file_name") == "icustays") & F.col("ctx_last_icu").isNotNull())
    dod, ce = F.col("dod_us"), F.col("ctx_last_icu_us")
    stay_in, stay_out = F.col("t_fwd"), F.col("end_us")
    labels = {f"ICU_Mortality_{d}day": _yn(dod.isNotNull() & _lt_hours(ce, dod, d * 24)) for d in (1, 2, 3, 7, 14)}
    for d in (7, 14):
        labels[f"ICU_Stay_{d}day"] = _yn(~_lt_hours(stay_in, stay_out, d * 24))
    labels["ICU_Readmission"] = _yn(F.col("icu_next_same").isNotNull())
    return _unpivot(e, labels, F.col("event_idx"), F.col("ctx_last_icu") + 1)


def discharge_labels(prepared: DataFrame) -> DataFrame:
    """L6-L7 (context: 24 h before the note, same visit, NULL = NULL)."""
    e = prepared.where((F.col("file_name") == "discharge") & F.col("ctx_begin").isNotNull())
    t = F.col("t_fwd")
    nxt = F.col("adm_next").isNotNull()
    labels = {
        "Readmission_30day": _yn(nxt & _lt_hours(t, F.col("adm_next_us"), 720)),
        "Readmission_60day": _yn(nxt & _lt_hours(t, F.col("adm_next_us"), 1440)),
    }
    return _unpivot(e, labels, F.col("ctx_begin"), F.col("event_idx") + 1)


def risk_samples(prepared: DataFrame) -> DataFrame:
    """The four extractors, unioned."""
    return (ed_labels(prepared).unionByName(admission_labels(prepared))
            .unionByName(icu_labels(prepared)).unionByName(discharge_labels(prepared)))


def extract_targets(marked_rows: DataFrame, task_map: DataFrame, bound_tasks: tuple[str, ...],
                    value_col: str = "target_text") -> DataFrame:
    """Per (event, decision task) the distinct trimmed non-empty values.

    ``task_map`` rows: (file_name, task); only ``bound_tasks`` (whose target key
    the rows carry in ``value_col``) are extracted. Scalar tasks (discharge) keep the single
    untrimmed text and produce nothing when the event has more than one."""
    v = F.col(value_col)
    present = v.isNotNull() & (v != "") & ~v.isin("nan", "NaN", "None")
    trimmed = F.trim(v)
    tm = F.broadcast(task_map.where(F.col("task_type") == "decision_making")
                     .where(F.col("task").isin(*bound_tasks)).select("file_name", "task"))
    # kinds without a task are not gathered at all
    per_event = (marked_rows.join(F.broadcast(tm.select("file_name").distinct()), "file_name", "left_semi").groupBy("subject_id", "event_idx", "file_name")
                 .agg(F.array_sort(F.collect_set(F.when(present & (trimmed != ""), trimmed))).alias("_vals"),
                      F.count(F.when(present, F.lit(1))).alias("_n"),
                      F.min_by(v, F.when(present, F.col("pos"))).alias("_first")))
    j = per_event.join(tm, "file_name")
    scalar = F.col("task") == "discharge"
    target = F.when(scalar, F.when(F.col("_n") == 1, F.array(F.col("_first")))).otherwise(
        F.when(F.size("_vals") > 0, F.col("_vals")))
    return (j.select("subject_id", "event_idx", "task", target.alias("target"))
            .where(F.col("target").isNotNull()))


def task_targets(rows: DataFrame, item_col: str = "item", time_col: str = "ts_us") -> DataFrame:
    """E5 for every decision task: (subject_id, event_idx, task, target) from rows (subject_id,
    event_idx, file_name, pos, time, ``item``: map of the record's fields).

    Each task reads its own target key. Transfers name the care unit, or the event type where
    there is none; a radiology field is a JSON list, of which every entry counts; discharge is
    one untrimmed text and nothing when the event has several; next_event is the kind of a
    timed event. Only distinct values of an event are gathered, combined before the shuffle."""
    def present(v):
        return v.isNotNull() & (F.trim(v) != "") & ~v.isin("nan", "NaN", "None")

    tasks = task_event_map(rows.sparkSession).where(F.col("task_type") == "decision_making")
    j = rows.join(F.broadcast(tasks.select("file_name", "task", "target_key")), "file_name")
    item, task = F.col(item_col), F.col("task")
    unit = item["careunit"]
    values = (F.when(task == "transfers", F.array(F.when(present(unit), unit).otherwise(item["eventtype"])))
              .when(task == "radiology", F.from_json(item["exam_name"], "array<string>"))
              .when(task == "next_event", F.array(F.when(F.col(time_col).isNotNull() & ~F.col("file_name").isin(*UNTIMED_KINDS),
                                                         F.col("file_name"))))
              .otherwise(F.array(F.try_element_at(item, F.col("target_key")))))
    v = F.col("_v")
    found = (j.select("subject_id", "event_idx", "task", F.explode(values).alias("_v")).where(present(v))
             .groupBy("subject_id", "event_idx", "task")
             .agg(F.array_sort(F.collect_set(F.trim(v))).alias("_vals"), F.count(F.lit(1)).alias("_n"), F.min(v).alias("_text")))
    target = F.when(task != "discharge", F.col("_vals")).when(F.col("_n") == 1, F.array("_text"))
    return found.select("subject_id", "event_idx", "task", target.alias("target")).where(F.col("target").isNotNull())


def decision_samples(prepared: DataFrame, targets: DataFrame, with_next_event: bool = True) -> DataFrame:
    """One row per (event, decision task) with a target and a 24 h backward context."""
    ev = prepared.where(F.col("ctx_begin").isNotNull())
    cols = ["subject_id", "hadm_id", "task", F.col("file_name").alias("event"), "event_idx",
            F.col("ctx_begin").alias("context_begin"), F.col("event_idx").alias("context_end"), "target",
            "admissions_id", "last_discharge_id"]
    out = ev.join(targets, ["subject_id", "event_idx"]).select(*cols)
    if with_next_event:
        nxt = (ev.where(F.col("t_back").isNotNull() & F.col("file_name").isin(*CONFIGURED_KINDS))
               .withColumn("task", F.lit("next_event")).withColumn("target", F.array("file_name")).select(*cols))
        out = out.unionByName(nxt)
    return out


def task_index(prepared: DataFrame, targets: DataFrame) -> DataFrame:
    """C14: decision and risk samples with their as-of admission / discharge links."""
    return decision_samples(prepared, targets).unionByName(risk_samples(prepared))
