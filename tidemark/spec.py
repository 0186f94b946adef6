"""Column-name spec for timelines and the task table.

Operators take column names from a :class:`TimelineSpec`, so the same code runs on
hospital-shaped tables and on the bound test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class TimelineSpec:
    subject: str = "subject_id"
    visit: str = "hadm_id"
    kind: str = "file_name"
    time_us: str = "ts_us"          # raw-row time as epoch microseconds (bigint)
    row_key: str = "row_id"         # natural tie-breaker of raw rows
    source_rank: str = "source_rank"
    pos: str = "pos"                # row position in the ordered timeline
    event_idx: str = "event_idx"    # event position (0 = demographics)
    start_us: str = "starttime_us"
    end_us: str = "endtime_us"
    items: str = "items"


DEFAULT = TimelineSpec()

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Event kinds per source, and their time column; None = untimed kind.
# ---------------------------------------------------------------------------
SOURCE_RANK = {"hosp": 0, "note": 1, "ed": 2, "icu": 3}
UNTIMED_KINDS = ("patients", "diagnoses_icd", "drgcodes")
DEMOGRAPHICS_KIND = "patients"
EVENT_DISPLAY_NAMES = {
    "patients": "Patient Demographics",
    "omr": "Online Medical Record",
    "pharmacy": "Pharmacy",
    "poe": "Provider Order Entry",
    "procedures_icd": "Procedures on International Classification of Diseases",
    "prescriptions": "Prescriptions",
    "services": "Services",
    "labevents": "Labotary Test Events",
    "microbiologyevents": "Microbiology Test Events",
    "admissions": "Admissions",
    "transfers": "Transfers",
    "emar": "Electronic Medicine Administration Record",
    "hcpcsevents": "Hcpcs Events",
    "diagnoses_icd": "Diagnoses on International Classification of Diseases",
    "drgcodes": "Drgcodes",
    "radiology": "Radiology Examinations",
    "discharge": "Discharge",
    "edstays": "EDstays",
    "triage": "Triage",
    "medrecon": "Medrecon",
    "pyxis": "Pyxis",
    "vitalsign": "Vitalsign",
    "diagnosis": "ED Diagnoses on International Classification of Diseases",
    "icustays": "ICUstays",
    "chartevents": "Chart Events",
    "ingredientevents": "Ingredient Events",
    "datetimeevents": "Datetime Events",
    "procedureevents": "Procedure Events",
    "inputevents": "Input Events",
    "outputevents": "Output Events",
}

# Fields shown of each configured kind's records (E7), in order.
INFO_KEYS = {
    "patients": ("anchor_age", "gender"),
    "omr": ("result_name", "result_value"),
    "pharmacy": ("medication", "proc_type", "status"),
    "prescriptions": ("drug", "ATC Type", "prod_strength", "dose_val_rx", "dose_unit_rx"),
    "poe": ("order_type", "order_subtype"),
    "procedures_icd": ("procedures", "CCS Type"),
    "services": ("curr_service",),
    "labevents": ("item_name", "valuenum", "valueuom", "ref_range_lower", "ref_range_upper", "flag", "comments"),
    "microbiologyevents": ("test_name", "dilution_text", "interpretation", "comments", "ab_name"),
    "admissions": ("admission_type", "admission_location", "admission_info"),
    "transfers": ("eventtype", "careunit"),
    "emar": ("medication", "event_txt"),
    "diagnoses_icd": ("diagnoses", "CCS Type"),
    "radiology": ("note_type", "exam_name", "text"),
    "discharge": ("note_type", "text"),
    "edstays": ("gender", "race"),
    "triage": ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity", "chiefcomplaint"),
    "medrecon": ("name", "ATC Type"),
    "pyxis": ("name",),
    "vitalsign": ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "rhythm"),
    "diagnosis": ("icd_title", "CCS Type"),
    "icustays": (),
    "chartevents": ("item_name", "valuenum", "valueuom", "warning"),
    "ingredientevents": ("item_name", "amount", "amountuom", "rate", "rateuom"),
    "datetimeevents": ("item_name",),
    "procedureevents": ("item_name", "value", "valueuom", "location", "locationcategory"),
    "inputevents": ("item_name", "amount", "amountuom", "rate", "rateuom"),
    "outputevents": ("item_name", "value", "valueuom"),
}


@dataclass(frozen=True)
class Layout:
    """Detailed text of one kind (E8): a line per record with {field} slots (none: heading only)."""
    line: str | None
    columns: tuple = ()        # table header; empty = a list
    rules: int | None = None   # rules under the header, as many as columns unless given
    sep: str = "\n"
    first_only: bool = False   # only the first record counts
    needs: str | None = None   # records without this field are left out
    strip: bool = True
    timed: bool = True         # the heading shows the start


_INPUTS = Layout("| {item_name} | {amount} | {amountuom} | {rate} | {rateuom} |", ("Item Name", "Amount", "Unit", "Rate", "Unit"), strip=False)
# Slots that are no plain field ("gender_name", "flag_name", "unit", "exam_names", "raw_service", "title",
# "more") are defined in operators/render.py. Spaces and rules are the reference's, its slips included.
DETAILED_LAYOUTS = {
    "patients": Layout("- Age: {anchor_age}\n- Gender: {gender_name}", first_only=True, timed=False),
    "omr": Layout("- {result_name}: {result_value}"),
    "pharmacy": Layout("| {medication} | {proc_type} |", ("Medication", "Proc_type")),
    "prescriptions": Layout("| {drug} | {prod_strength} | {dose_val_rx} | {dose_unit_rx} |",
                            ("Drug", "Prod_Strength", "Dose_Val_Rx", "Dose_Unit_Rx")),
    "poe": Layout("- {order_type}: {order_subtype}"),
    "procedures_icd": Layout("- {procedures}"),
    "services": Layout("- {raw_service}"),
    "labevents": Layout("| {item_name} | {valuenum} | {valueuom} | {ref_range_lower}-{ref_range_upper} | {flag_name} | {comments} |",
                        ("Item Name", "Value", "Unit", "Range", "Flag", "Comments"), needs="valuenum"),
    "microbiologyevents": Layout("| {test_name} | {ab_name} | {dilution_text} | {interpretation} | {comments} |",
                                 ("Item Name", "AB Name", "Dilution Text", "Interpretation", "Comments"), rules=6),
    "admissions": Layout("- Admission Type: {admission_type}\n- Admission Location: {admission_location}{more}", first_only=True),
    "transfers": Layout("- {unit}"),
    "emar": Layout("- {medication}"),
    "diagnoses_icd": Layout("- {diagnoses}"),
    "radiology": Layout("- Note Type: {note_type}\n- Exam Name: {exam_names}\n- Report:\n{text}"),
    "discharge": Layout("- Note Type: {note_type}\n- Report:\n{text}"),
    "edstays": Layout(None),
    "triage": Layout("- Temperature: {temperature}\n- Heartrate: {heartrate}\n- Resprate: {resprate}\n-O2sat: {o2sat}\n-Sbp: {sbp}\n- Dbp: {dbp}"
                     "\n- Pain: {pain}\n- Acuity: {acuity}\n- Chiefcomplaint: {chiefcomplaint}", sep=" \n"),
    "medrecon": Layout("- {name}", sep=" \n"),
    "pyxis": Layout("- {name}", sep=" \n"),
    "vitalsign": Layout("- Temperature: {temperature}\n- Heartrate: {heartrate}\n- Resprate: {resprate}\n- O2sat: {o2sat}\n- Sbp: {sbp}\n- Dbp: {dbp}"
                        "\n- Pain: {pain}\n- Rhythm: {rhythm}", sep=" \n"),
    "diagnosis": Layout("- {title}", sep=" \n"),
    "icustays": Layout(None),
    "chartevents": Layout("| {item_name} | {valuenum} | {valueuom} | {warning}", ("Item Name", "Value", "Unit", "Warning"), strip=False),
    "ingredientevents": _INPUTS,
    "datetimeevents": Layout("- {item_name}", strip=False),
    "procedureevents": Layout("| {item_name} | {value} | {valueuom} | {location} | {locationcategory} |",
                              ("Item Name", "Value", "Unit", "Location", "Location Category"), strip=False),
    "inputevents": _INPUTS,
    "outputevents": Layout("| {item_name} | {value} | {valueuom} |", ("Item Name", "Value", "Unit"), strip=False),
}

# Task table: (task, event kind, target key, metric, hidden kinds, task type).
# "any" = every event kind. Fixed values, in the reference's order.
TASK_ROWS = [
    ("admissions", "admissions", "admission_type", "em", [], "decision_making"),
    ("omr", "omr", "result_name", "em", [], "decision_making"),
    ("procedures_icd", "procedures_icd", "procedures", "recall", [], "decision_making"),
    ("procedures_ccs", "procedures_icd", "CCS Type", "recall", [], "decision_making"),
    ("diagnoses_icd", "diagnoses_icd", "diagnoses", "recall", ["discharge"], "decision_making"),
    ("diagnoses_ccs", "diagnoses_icd", "CCS Type", "recall", ["discharge"], "decision_making"),
    ("labevents", "labevents", "item_name", "em", [], "decision_making"),
    ("microbiologyevents", "microbiologyevents", "test_name", "em", [], "decision_making"),
    ("services", "services", "curr_service", "em", [], "decision_making"),
    ("transfers", "transfers", "eventtype", "em", [], "decision_making"),
    ("emar", "emar", "medication", "em", [], "decision_making"),
    ("poe", "poe", "order_type", "em", [], "decision_making"),
    ("prescriptions", "prescriptions", "drug", "recall", [], "decision_making"),
    ("prescriptions_atc", "prescriptions", "ATC Type", "recall", [], "decision_making"),
    ("radiology", "radiology", "exam_name", "em", [], "decision_making"),
    ("discharge", "discharge", "text", "rouge", [], "decision_making"),
    ("medrecon", "medrecon", "name", "recall", [], "decision_making"),
    ("medrecon_atc", "medrecon", "ATC Type", "recall", [], "decision_making"),
    ("pyxis", "pyxis", "name", "em", [], "decision_making"),
    ("diagnosis", "diagnosis", "icd_title", "recall", ["discharge"], "decision_making"),
    ("diagnosis_ccs", "diagnosis", "CCS Type", "recall", ["discharge"], "decision_making"),
    ("chartevents", "chartevents", "item_name", "em", [], "decision_making"),
    ("ingredientevents", "ingredientevents", "item_name", "em", [], "decision_making"),
    ("datetimeevents", "datetimeevents", "item_name", "em", [], "decision_making"),
    ("procedureevents", "procedureevents", "item_name", "em", [], "decision_making"),
    ("inputevents", "inputevents", "item_name", "em", [], "decision_making"),
    ("outputevents", "outputevents", "item_name", "em", [], "decision_making"),
    ("next_event", "any", "file_name", "acc", [], "decision_making"),
    ("ED_Hospitalization", "edstays", None, "aucroc", [], "risk_prediction"),
    ("ED_Inpatient_Mortality", "edstays", None, "aucroc", [], "risk_prediction"),
    ("ED_ICU_Tranfer_12hour", "edstays", None, "aucroc", [], "risk_prediction"),
    ("ED_Reattendance_3day", "edstays", None, "aucroc", [], "risk_prediction"),
    ("ED_Critical_Outcomes", "edstays", None, "aucroc", [], "risk_prediction"),
    ("Readmission_30day", "discharge", None, "aucroc", [], "risk_prediction"),
    ("Readmission_60day", "discharge", None, "aucroc", [], "risk_prediction"),
    ("Inpatient_Mortality", "admissions", None, "aucroc", [], "risk_prediction"),
    ("LengthOfStay_3day", "admissions", None, "aucroc", [], "risk_prediction"),
    ("LengthOfStay_7day", "admissions", None, "aucroc", [], "risk_prediction"),
    ("ICU_Mortality_1day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Mortality_2day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Mortality_3day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Mortality_7day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Mortality_14day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Stay_7day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Stay_14day", "icustays", None, "aucroc", [], "risk_prediction"),
    ("ICU_Readmission", "icustays", None, "aucroc", [], "risk_prediction"),
]

# Decision-task rules: tasks sampled by weight (D11), and tasks whose target is one string.
WEIGHTED_TASKS = ("chartevents", "emar", "next_event")
SCALAR_TARGET_TASKS = ("discharge", "next_event")

TASK_SCHEMA = T.StructType([
    T.StructField("task", T.StringType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("target_key", T.StringType(), True),
    T.StructField("metric", T.StringType(), False),
    T.StructField("bid_event", T.ArrayType(T.StringType()), False),
    T.StructField("task_type", T.StringType(), False),
])


@dataclass(frozen=True)
class TaskSpec:
    task: str
    event: str
    target_key: str | None
    metric: str
    bid_event: tuple = field(default_factory=tuple)
    task_type: str = "decision_making"

    @property
    def instruction(self) -> str:
        # Our own wording; the task name is the only varying part.
        shown = EVENT_DISPLAY_NAMES.get(self.event, self.task.replace("_", " "))
        if self.task_type == "risk_prediction":
            return f"Based on the hospital events so far, answer yes or no: {self.task.replace('_', ' ')}?"
        return f"Based on the hospital events so far, list the next {shown} entries for this patient."


TASKS = [TaskSpec(t, e, k, m, tuple(b), tt) for t, e, k, m, b, tt in TASK_ROWS]
TASK_BY_NAME = {t.task: t for t in TASKS}


def task_frame(spark: SparkSession, tasks: list[TaskSpec] | None = None) -> DataFrame:
    """The task table as a (tiny, fixed-size) DataFrame for broadcast joins."""
    rows = [(t.task, t.event, t.target_key, t.metric, list(t.bid_event), t.task_type) for t in (tasks or TASKS)]
    return spark.createDataFrame(rows, TASK_SCHEMA)
