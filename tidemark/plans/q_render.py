"""E family queries: lookups, value cleaning, event rendering, context text, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import clean_value, truncate_left
from tidemark.functions.time import epoch_us
from tidemark.operators import lookup as lk
from tidemark.operators import render as rd
from tidemark.plans import bindings as b
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.session import materialize, staged
from tidemark.sources.tables import table
from tidemark.spec import EVENT_DISPLAY_NAMES, INFO_KEYS, TASKS, UNTIMED_KINDS, task_frame

KEY = ["subject_id", "event_idx", "task"]
NL = "chr(10)"


@query("e_lookup_versioned", ctes("o_rows", "o_icd") + """
SELECT r.row_id, r.icd_version, r.icd_code, d.long_title FROM o_rows r
LEFT JOIN o_icd d USING (icd_version, icd_code) WHERE r.file_name = 'diagnoses_icd'""")
def e_lookup_versioned(spark, sf):
    rows = b.raw_rows(spark, sf).where(F.col("file_name") == "diagnoses_icd").select("row_id", "icd_version", "icd_code")
    return lk.lookup_versioned(rows, b.icd_dim(spark, sf)).select("row_id", "icd_version", "icd_code", "long_title")


_NDC_SQL = """CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey * 1000 + 1 AS VARCHAR) || '.0'
                   ELSE CAST(l_partkey * 100000000 + l_suppkey AS VARCHAR) END"""


@query("e_lookup_ndc", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ndc, ndc_key, d.atc_name FROM (
  SELECT *, CASE WHEN length(split_part(ndc, '.', 1)) >= 11 THEN split_part(ndc, '.', 1)
                 ELSE lpad(split_part(ndc, '.', 1), 11, '0') END AS ndc_key
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_NDC_SQL} AS ndc FROM lineitem)) x
LEFT JOIN (SELECT ndc_code, arg_max(atc_name, seq) AS atc_name FROM (
    SELECT lpad(CAST(p_partkey * 1000 + 1 AS VARCHAR), 11, '0') AS ndc_code, lower(p_type) AS atc_name, 1 AS seq FROM part
    UNION ALL SELECT lpad(CAST(p_partkey * 1000 + 1 AS VARCHAR), 11, '0'), p_brand, 2 FROM part) GROUP BY ndc_code) d
  ON d.ndc_code = x.ndc_key""")
def e_lookup_ndc(spark, sf):
    p = table(spark, sf, "part")
    code = F.lpad((F.col("p_partkey") * 1000 + 1).cast("string"), 11, "0").alias("ndc_code")
    dim = (p.select(code, F.lower("p_type").alias("atc_name"), F.lit(1).alias("seq"))
           .unionByName(p.select(code, F.col("p_brand").alias("atc_name"), F.lit(2).alias("seq"))))
    dim = lk.dedup_last(dim, "ndc_code", "seq")
    li = table(spark, sf, "lineitem")
    ndc = (F.when(F.col("l_linestatus") == "O", F.concat((F.col("l_partkey") * 1000 + 1).cast("string"), F.lit(".0")))
           .otherwise((F.col("l_partkey") * 100000000 + F.col("l_suppkey")).cast("string")))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ndc.alias("ndc"))
    return lk.lookup_ndc(rows, dim).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ndc", "ndc_key",
                                           "atc_name")


@query("e_lookup_item", ctes("o_rows") + """
SELECT r.row_id, r.k, p.p_name AS item_label FROM o_rows r LEFT JOIN part p ON p.p_partkey = r.k
WHERE r.file_name = 'labevents'""")
def e_lookup_item(spark, sf):
    rows = b.raw_rows(spark, sf).where(F.col("file_name") == "labevents").select("row_id", "k")
    return lk.lookup_item(rows, b.lab_items(spark, sf), "k", "item_label")


@query("e_lookup_multi", """
SELECT l_orderkey AS note_id, string_agg(DISTINCT v, '|' ORDER BY v) AS exam_names FROM (
  SELECT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'exam_name' ELSE 'other' END AS field_name,
         'exam ' || CAST(l_partkey % 50 AS VARCHAR) AS v FROM lineitem)
WHERE field_name = 'exam_name' GROUP BY l_orderkey""")
def e_lookup_multi(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("note_id"),
        F.when(F.col("l_linestatus") == "O", F.lit("exam_name")).otherwise(F.lit("other")).alias("field_name"),
        F.concat(F.lit("exam "), (F.col("l_partkey") % 50).cast("string")).alias("field_value"))
    d = lk.multi_value_dim(li, "note_id", "field_name", "field_value", "exam_name")
    return d.select("note_id", F.array_join("values", "|").alias("exam_names"))


@query("e_clean_value", """
SELECT event_id, CASE WHEN t IS NULL OR t IN ('NaN', 'nan', 'None') THEN '' ELSE t END AS clean,
       CASE WHEN t IS NULL OR t IN ('NaN', 'nan', 'None') THEN NULL ELSE t END AS clean_null
FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'nan' WHEN 'error' THEN 'None'
                        ELSE printf('%.2f', value) END AS t FROM events)""")
def e_clean_value(spark, sf):
    ev = table(spark, sf, "events")
    t = (F.when(F.col("event_type") == "signup", F.lit("nan")).when(F.col("event_type") == "error", F.lit("None"))
         .otherwise(F.format_string("%.2f", F.col("value"))))
    return ev.select("event_id", clean_value(t).alias("clean"), clean_value(t, empty_as_null=True).alias("clean_null"))


# --- event rendering -----------------------------------------------------------------
def _v2(c):
    return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c)))


def bound_specs(detailed: bool = False):
    specs = {
        "patients": [("dod", rd.fmt_us(F.col("dod_us"), "yyyy-MM-dd"))],
        "admissions": [("admission_type", F.col("target_text")), ("dischtime", rd.fmt_us(F.col("end_us")))],
        "labevents": [("item_name", F.col("target_text")), ("valuenum", _v2("value"))],
        "diagnoses_icd": [("icd_code", F.col("icd_code")), ("icd_version", F.col("icd_version")),
                          ("diagnoses", F.col("target_text"))],
        "discharge": [("text", F.col("target_text"))],
        "edstays": [("outtime", rd.fmt_us(F.col("end_us"))), ("acuity", _v2("value"))],
        "icustays": [("outtime", rd.fmt_us(F.col("end_us")))],
    }
    if detailed:
        specs["labevents"] = [("itemid", F.col("k").cast("string"))] + specs["labevents"] + [("flag", F.when(
            F.col("value") > 100, F.lit("abnormal")).otherwise(F.lit("normal")))]
        specs["admissions"] = specs["admissions"] + [("hadm_id", F.col("hadm_id").cast("string"))]
    return specs


def _ts_sql(c, fmt="%Y-%m-%d %H:%M:%S"):
    return f"strftime(make_timestamp({c}), '{fmt}')"


def _v2_sql(c):
    return f"printf('%.2f', {c})"


def _sql_specs(detailed=False):
    specs = {
        "patients": [("dod", _ts_sql("dod_us", "%Y-%m-%d"))],
        "admissions": [("admission_type", "target_text"), ("dischtime", _ts_sql("end_us"))],
        "labevents": [("item_name", "target_text"), ("valuenum", _v2_sql("value"))],
        "diagnoses_icd": [("icd_code", "icd_code"), ("icd_version", "icd_version"), ("diagnoses", "target_text")],
        "discharge": [("text", "target_text")],
        "edstays": [("outtime", _ts_sql("end_us")), ("acuity", _v2_sql("value"))],
        "icustays": [("outtime", _ts_sql("end_us"))],
    }
    if detailed:
        specs["labevents"] = [("itemid", "CAST(k AS VARCHAR)")] + specs["labevents"] + [
            ("flag", "CASE WHEN value > 100 THEN 'abnormal' ELSE 'normal' END")]
        specs["admissions"] = specs["admissions"] + [("hadm_id", "CAST(hadm_id AS VARCHAR)")]
    return specs


def _render_sql(detailed=False):
    specs = _sql_specs(detailed)
    b_cases, r_cases, h_cases = [], [], []
    for k, cols in specs.items():
        vals = [f"coalesce(CAST({c} AS VARCHAR), 'None')" for _, c in cols]
        bl = f" || {NL} || ".join(f"'- {n.title()}: ' || {v}" for (n, _), v in zip(cols, vals))
        r = "'| ' || " + " || ' | ' || ".join(vals) + " || ' |'"
        h = ("| " + " | ".join(n.title() for n, _ in cols) + " |' || " + NL + " || '| " +
             " | ".join(["------"] * len(cols)) + " |")
        b_cases.append(f"WHEN '{k}' THEN {bl}")
        r_cases.append(f"WHEN '{k}' THEN {r}")
        h_cases.append(f"WHEN '{k}' THEN '{h}'")
    disp = "CASE file_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_DISPLAY_NAMES.items()) + " END"
    kinds = ", ".join(f"'{k}'" for k in specs)
    return f"""
  SELECT subject_id, event_idx, file_name, n_items,
         CASE WHEN file_name IN ({kinds}) THEN '## ' || {disp} || ' [' ||
              coalesce(CASE WHEN file_name NOT IN ('patients', 'diagnoses_icd', 'drgcodes') THEN {_ts_sql('st')} END, 'None')
              || ']' || {NL} || CASE WHEN n_items = 1 THEN b ELSE h || {NL} || rws END
              ELSE '' END AS text
  FROM (SELECT subject_id, event_idx, first(file_name ORDER BY pos) AS file_name, count(*) AS n_items,
               first(b ORDER BY pos) AS b, first(h ORDER BY pos) AS h, string_agg(r, {NL} ORDER BY pos) AS rws,
               first(ts_us ORDER BY pos) FILTER (WHERE ts_us IS NOT NULL) AS st
        FROM (SELECT *, CASE file_name {' '.join(b_cases)} END AS b, CASE file_name {' '.join(r_cases)} END AS r,
                     CASE file_name {' '.join(h_cases)} END AS h FROM o_marked)
        GROUP BY subject_id, event_idx)"""


cte("o_etext", ("o_marked",), _render_sql(False))
cte("o_etext_detailed", ("o_marked",), _render_sql(True))


def _etext(spark, sf, detailed=False, marked=None):
    marked = marked if marked is not None else b.marked_rows(spark, sf)
    return rd.render_events(marked, bound_specs(detailed))


@query("e_render_single", ctes("o_etext") + "SELECT subject_id, event_idx, text FROM o_etext WHERE n_items = 1")
def e_render_single(spark, sf):
    return _etext(spark, sf).where(F.col("n_items") == 1).select("subject_id", "event_idx", "text")


@query("e_render_table", ctes("o_etext") + "SELECT subject_id, event_idx, text FROM o_etext WHERE n_items > 1")
def e_render_table(spark, sf):
    return _etext(spark, sf).where(F.col("n_items") > 1).select("subject_id", "event_idx", "text")


@query("e_render_detailed", ctes("o_etext_detailed") + "SELECT subject_id, event_idx, text FROM o_etext_detailed")
def e_render_detailed(spark, sf):
    return _etext(spark, sf, detailed=True).select("subject_id", "event_idx", "text")


# Records of all 28 configured kinds: an order's line items of one kind are an event, their fields come from the part.
_KINDS = sorted(INFO_KEYS)
_FIELDS = sorted({k for keys in INFO_KEYS.values() for k in keys})


def _pos():
    """Line numbers repeat within an order."""
    return ((F.col("l_linenumber").cast("bigint") * 100_000 + F.unix_date(F.col("l_shipdate").cast("date"))) * 10 ** 12
            + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))


RECORD_ROWS = 250_000  # of a task that renders records


def record_rows(spark, sf):
    """(rows of all kinds, function of a field's name to its column). An order's rows lie together.

    Line items meet their parts first, which are written: sorted by part they take little room, and the join's shuffles go. The
    rows then move once, as they were read, with a part's name and type only where their kind shows them."""
    at = (F.col("l_partkey") % len(_KINDS)).cast("int")
    kind = F.get(F.array(*map(F.lit, _KINDS)), at)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    fields = {k: F.when((F.col("l_partkey") + i) % 11 == 0, F.lit(None)).when((F.col("l_partkey") + i) % 7 == 0, F.lit("nan"))
              .otherwise(F.concat(F.lit(k + " "), "p_brand")) for i, k in enumerate(_FIELDS)}
    fields |= {"gender": F.when(F.col("l_returnflag") == "R", F.lit("M")).otherwise(F.lit("F")), "text": F.concat("p_name", F.lit("\n")),
               "exam_name": F.to_json(F.array("p_brand", "p_type")), "icd_title": F.upper("p_type"),
               "admission_info": F.to_json(F.struct(F.col("p_brand").alias("b"), F.col("p_type").alias("a")))}
    named, typed = rd.kinds_with("text"), rd.kinds_with("exam_name", "icd_title", "admission_info")
    found = staged(li.join(p, "l_partkey").withColumns({"p_name": F.when(kind.isin(named), F.col("p_name")), "p_type": F.when(kind.isin(typed), F.col("p_type"))}))
    # with more rows there are more tasks, and adaptive execution leaves them as they are
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // RECORD_ROWS))
    rows = found.repartition(n, "l_orderkey").join(o, "l_orderkey")
    return rows.select(
        "l_orderkey", "subject_id", "l_partkey", "l_returnflag", "p_name", "p_brand", "p_type", (F.col("l_orderkey").cast("bigint") * 100 + at).alias("event_idx"),
        kind.alias("file_name"), _pos().alias("pos"), epoch_us("l_shipdate").alias("ts_us")), fields.__getitem__


def _field_sql(k):
    """The field as stored."""
    i = _FIELDS.index(k)
    return {"gender": "CASE l_returnflag WHEN 'R' THEN 'M' ELSE 'F' END", "text": f"p_name || {NL}", "icd_title": "upper(p_type)",
            "exam_name": "'[' || chr(39) || p_brand || chr(39) || ', ' || chr(39) || p_type || chr(39) || ']'",
            "admission_info": "'{\"b\":\"' || p_brand || '\",\"a\":\"' || p_type || '\"}'"}.get(
        k, f"CASE WHEN (l_partkey + {i}) % 11 = 0 THEN NULL WHEN (l_partkey + {i}) % 7 = 0 THEN 'nan' ELSE '{k} ' || p_brand END")


def _shown_sql(k):
    """The field, empty if missing."""
    return f"replace(coalesce({_field_sql(k)}, ''), 'nan', '')" if "p_name" not in _field_sql(k) and "p_type" not in _field_sql(k) else _field_sql(k)


def _line_sql(*parts):
    """Words and, as one-element lists, fields."""
    return " || ".join(_shown_sql(x[0]) if isinstance(x, list) else x if x.startswith("(") else
                       "'" + x.replace("\n", f"' || {NL} || '") + "'" for x in parts)


def _bar_sql(*fields, end=" |"):
    return _line_sql("| ", *[y for i, f in enumerate(fields) for y in ([" | "] if i else []) + [[f]]], end)


def _vital_sql(*fields, tight=()):
    return _line_sql(*[y for i, f in enumerate(fields) for y in (("\n" if i else "") + ("-" if f in tight else "- ") + f.capitalize() + ": ", [f])])


_LINES_SQL = {
    "patients": _line_sql("- Age: ", ["anchor_age"], "\n- Gender: ", "(CASE l_returnflag WHEN 'R' THEN 'Male' ELSE 'Female' END)"),
    "omr": _line_sql("- ", ["result_name"], ": ", ["result_value"]),
    "pharmacy": _bar_sql("medication", "proc_type"),
    "prescriptions": _bar_sql("drug", "prod_strength", "dose_val_rx", "dose_unit_rx"),
    "poe": _line_sql("- ", ["order_type"], ": ", ["order_subtype"]),
    "procedures_icd": _line_sql("- ", ["procedures"]),
    "services": "'- ' || coalesce(" + _field_sql("curr_service") + ", 'None')",
    "labevents": f"CASE WHEN {_shown_sql('valuenum')} <> '' THEN " + _line_sql(
        "| ", ["item_name"], " | ", ["valuenum"], " | ", ["valueuom"], " | ", ["ref_range_lower"], "-", ["ref_range_upper"], " | ",
        f"(coalesce(nullif({_shown_sql('flag')}, ''), 'normal'))", " | ", ["comments"], " |") + " END",
    "microbiologyevents": _bar_sql("test_name", "ab_name", "dilution_text", "interpretation", "comments"),
    "admissions": _line_sql("- Admission Type: ", ["admission_type"], "\n- Admission Location: ", ["admission_location"],
                            f"('- b: ' || p_brand || {NL} || '- a: ' || p_type || {NL})"),
    "transfers": _line_sql("- ", f"(CASE WHEN {_shown_sql('careunit')} <> '' THEN {_shown_sql('careunit')} || {NL} ELSE {_shown_sql('eventtype')} END)"),
    "emar": _line_sql("- ", ["medication"]),
    "diagnoses_icd": _line_sql("- ", ["diagnoses"]),
    "radiology": _line_sql("- Note Type: ", ["note_type"], "\n- Exam Name: ", "(p_brand || ', ' || p_type)", "\n- Report:\n", ["text"]),
    "discharge": _line_sql("- Note Type: ", ["note_type"], "\n- Report:\n", ["text"]),
    "triage": _vital_sql("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity", "chiefcomplaint", tight=("o2sat", "sbp")),
    "medrecon": _line_sql("- ", ["name"]),
    "pyxis": _line_sql("- ", ["name"]),
    "vitalsign": _vital_sql("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "rhythm"),
    "diagnosis": "'- ' || upper(p_type[1]) || lower(p_type[2:])",
    "chartevents": _bar_sql("item_name", "valuenum", "valueuom", "warning", end=""),
    "ingredientevents": _bar_sql("item_name", "amount", "amountuom", "rate", "rateuom"),
    "datetimeevents": _line_sql("- ", ["item_name"]),
    "procedureevents": _bar_sql("item_name", "value", "valueuom", "location", "locationcategory"),
    "inputevents": _bar_sql("item_name", "amount", "amountuom", "rate", "rateuom"),
    "outputevents": _bar_sql("item_name", "value", "valueuom"),
}
_HEADS_SQL = {
    "pharmacy": ("| Medication | Proc_type |", 2), "prescriptions": ("| Drug | Prod_Strength | Dose_Val_Rx | Dose_Unit_Rx |", 4),
    "labevents": ("| Item Name | Value | Unit | Range | Flag | Comments |", 6),
    "microbiologyevents": ("| Item Name | AB Name | Dilution Text | Interpretation | Comments |", 6),
    "chartevents": ("| Item Name | Value | Unit | Warning |", 4), "ingredientevents": ("| Item Name | Amount | Unit | Rate | Unit |", 5),
    "procedureevents": ("| Item Name | Value | Unit | Location | Location Category |", 5),
    "inputevents": ("| Item Name | Amount | Unit | Rate | Unit |", 5), "outputevents": ("| Item Name | Value | Unit |", 3),
}
_UNTIMED_SQL = ", ".join(f"'{k}'" for k in UNTIMED_KINDS)
_DISPLAY_SQL = "CASE file_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_DISPLAY_NAMES.items()) + " END"


@query("e_render_kinds", f"""
WITH k(file_name, k_pos) AS (VALUES {", ".join(f"('{k}', {i})" for i, k in enumerate(_KINDS))}),
c(file_name, c_pos, key, title) AS (VALUES {", ".join(f"('{k}', {i}, '{x}', '{x.title()}')" for k, keys in INFO_KEYS.items() for i, x in enumerate(keys))}),
r AS (SELECT o_custkey AS subject_id, CAST(o_orderkey AS BIGINT) * 100 + k_pos AS event_idx, file_name, (CAST(l_linenumber AS BIGINT) * 100000 + (CAST(l_shipdate AS DATE) - DATE '1970-01-01')) * 1000000000000 + l_partkey * 10000 + l_suppkey AS pos, l_partkey, p_name,
             p_brand, p_type, l_returnflag, strftime(CAST(l_shipdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS st
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN k ON k_pos = l_partkey % {len(_KINDS)}),
v AS (SELECT r.*, c_pos, title, coalesce(CASE key {" ".join(f"WHEN '{k}' THEN {_field_sql(k)}" for k in _FIELDS)} END, 'None') AS v
      FROM r LEFT JOIN c USING (file_name)),
l AS (SELECT subject_id, event_idx, pos, coalesce(string_agg('- ' || title || ': ' || v, {NL} ORDER BY c_pos) FILTER (WHERE c_pos IS NOT NULL), '') AS b,
             '| ' || coalesce(string_agg(v, ' | ' ORDER BY c_pos) FILTER (WHERE c_pos IS NOT NULL), '') || ' |' AS t,
             '| ' || coalesce(string_agg(title, ' | ' ORDER BY c_pos), '') || ' |' || {NL} || '| ' || coalesce(string_agg('------', ' | ') FILTER (WHERE c_pos IS NOT NULL), '') || ' |' AS h
      FROM v GROUP BY ALL),
d AS (SELECT r.*, CASE file_name {" ".join(f"WHEN '{k}' THEN {x}" for k, x in _LINES_SQL.items())} END AS d FROM r),
e AS (SELECT subject_id, event_idx, file_name, count(*) AS n_items, first(st ORDER BY pos) AS st, first(b ORDER BY pos) AS b, first(h) AS h,
             string_agg(t, {NL} ORDER BY pos) AS t, first(d ORDER BY pos) AS d1, string_agg(d, {NL} ORDER BY pos) AS dl,
             string_agg(d, ' ' || {NL} ORDER BY pos) AS ds FROM d JOIN l USING (subject_id, event_idx, pos) GROUP BY ALL),
x AS (SELECT subject_id, event_idx, file_name, n_items, '## ' || {_DISPLAY_SQL} AS name, st, b, h, t,
             CASE file_name {" ".join(f"WHEN '{k}' THEN '{h}' || {NL} || '|{' ------ |' * n}' || {NL}" for k, (h, n) in _HEADS_SQL.items())} ELSE '' END ||
             coalesce(CASE WHEN file_name IN ('patients', 'admissions') THEN d1 WHEN file_name IN ('triage', 'medrecon', 'pyxis', 'vitalsign', 'diagnosis') THEN ds
                           ELSE dl END, '') AS body FROM e)
SELECT subject_id, event_idx, file_name, n_items, 'keys' AS style, name || ' [' || CASE WHEN file_name IN ({_UNTIMED_SQL}) THEN 'None' ELSE st END || ']' || {NL} ||
       CASE WHEN n_items = 1 THEN b ELSE h || {NL} || t END AS text FROM x
UNION ALL
SELECT subject_id, event_idx, file_name, n_items, 'detailed',
       CASE WHEN file_name IN ('chartevents', 'ingredientevents', 'inputevents', 'outputevents', 'procedureevents', 'datetimeevents') THEN name || ' [' || st || ']' || {NL} || body
            ELSE trim(name || CASE WHEN file_name = 'patients' THEN '' ELSE ' [' || st || ']' END || {NL} || body, ' ' || {NL}) END FROM x""")
def e_render_kinds(spark, sf):
    rows, field = record_rows(spark, sf)
    by = ("l_orderkey",)
    out = rd.render_events(rows, rd.record_specs(field), by=by).withColumn("style", F.lit("keys")).unionByName(
        rd.render_detailed(rows, item_col=field, by=by).withColumn("style", F.lit("detailed")))
    return out.select("subject_id", "event_idx", "file_name", "n_items", "style", "text")


_HIDDEN_SQL = "'" + "', '".join(t.task for t in TASKS if "discharge" in t.bid_event) + "'"
cte("o_ctx", ("o_index", "o_etext"), f"""
  SELECT s.subject_id, s.event_idx, s.task, s.target,
         array_to_string(list_concat([coalesce(p.text, ''), coalesce(d.text, ''),
                                      coalesce(CASE WHEN s.task <> 'admissions' THEN a.text END, '')],
                                     coalesce(c.blocks, [])), {NL} || {NL}) AS input,
         coalesce(c.n, 0) AS n_context
  FROM o_index s
  LEFT JOIN o_etext p ON p.subject_id = s.subject_id AND p.event_idx = 0
  LEFT JOIN o_etext d ON d.subject_id = s.subject_id AND d.event_idx = s.last_discharge_id
  LEFT JOIN o_etext a ON a.subject_id = s.subject_id AND a.event_idx = s.admissions_id
  LEFT JOIN (SELECT s.subject_id, s.event_idx, s.task, list(e.text ORDER BY e.event_idx) AS blocks, count(*) AS n
             FROM o_index s JOIN o_etext e ON e.subject_id = s.subject_id
              AND e.event_idx >= s.context_begin AND e.event_idx < s.context_end
             WHERE e.file_name <> 'admissions' AND NOT (e.file_name = 'discharge' AND s.task IN ({_HIDDEN_SQL}))
             GROUP BY ALL) c ON c.subject_id = s.subject_id AND c.event_idx = s.event_idx AND c.task = s.task""")


def contexts(spark, sf, pl=None, carry=(), tasks=None):
    """(index, its samples with their context text), of all tasks or those given."""
    pl = pl or b.pipeline(spark, sf)
    idx = pl.index if tasks is None else pl.index.where(F.col("task").isin(*tasks))
    texts = materialize(_etext(spark, sf, marked=pl.marked))
    hidden = task_frame(spark).select("task", "bid_event")
    ctx = rd.context_text(idx, texts, hidden, carry=carry)
    return idx, ctx


def keyed(ctx):
    """Samples whose whole key is known."""
    return ctx.dropna(subset=KEY)


@query("e_context_text", ctes("o_ctx") + """
SELECT subject_id, event_idx, task, md5(input) AS input_md5, length(input) AS input_len, n_context FROM o_ctx""")
def e_context_text(spark, sf):
    _, ctx = contexts(spark, sf)
    return ctx.select(*KEY, F.md5("input").alias("input_md5"), F.length("input").cast("bigint").alias("input_len"),
                      F.col("n_context").cast("bigint").alias("n_context"))


INSTR_SQL = "(VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(t.task, t.instruction.replace("'", "''"), t.task_type) for t in TASKS) + \
    ") ins(task, instruction, task_type)"


def instructions(spark):
    return spark.createDataFrame([(t.task, t.instruction, t.task_type) for t in TASKS],
                                 "task string, instruction string, task_type string")


@query("e_sample", ctes("o_ctx") + f"""
SELECT subject_id, event_idx, task, instruction, replace(target, '|', {NL}) AS output, md5(input) AS input_md5
FROM o_ctx JOIN {INSTR_SQL} USING (task) WHERE target <> ''""")
def e_sample(spark, sf):
    _, ctx = contexts(spark, sf, carry=("target",))
    s = keyed(ctx).join(F.broadcast(instructions(spark)), "task").where(F.size("target") > 0)
    return s.select(*KEY, "instruction", rd.sample_output("target").alias("output"), F.md5("input").alias("input_md5"))


_PROMPT_SQL = f"""input || {NL} || {NL} || instruction ||
    CASE WHEN task_type = 'risk_prediction' THEN {NL} || 'Reply with yes or no.' ELSE {NL} || 'Reply with one answer per line.' END
    || {NL} || '/no_think'"""


@query("e_prompt", ctes("o_ctx") + f"""
SELECT subject_id, event_idx, task, md5({_PROMPT_SQL}) AS prompt_md5, length({_PROMPT_SQL}) AS prompt_len
FROM o_ctx JOIN {INSTR_SQL} USING (task)""")
def e_prompt(spark, sf):
    _, ctx = contexts(spark, sf)
    s = ctx.join(F.broadcast(instructions(spark)), "task")
    p = rd.build_prompt(F.col("input"), F.col("instruction"), task_type=F.col("task_type"))
    return s.select(*KEY, F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_len"))


SYSTEM_TEXT = "You are a careful clinical assistant."


@query("e_chat", ctes("o_ctx") + f"""
SELECT subject_id, event_idx, task, 3 AS n_messages, 'system|user|assistant' AS roles,
       md5('{SYSTEM_TEXT}' || {NL} || ({_PROMPT_SQL}) || {NL} || replace(target, '|', {NL})) AS chat_md5
FROM o_ctx JOIN {INSTR_SQL} USING (task)""")
def e_chat(spark, sf):
    _, ctx = contexts(spark, sf, carry=("target",))
    s = keyed(ctx).join(F.broadcast(instructions(spark)), "task")
    prompt = rd.build_prompt(F.col("input"), F.col("instruction"), task_type=F.col("task_type"))
    chat = rd.build_chat(prompt, F.lit(SYSTEM_TEXT), rd.sample_output("target"))
    return s.select(*KEY, F.size(chat).alias("n_messages"),
                    F.array_join(F.transform(chat, lambda m: m["role"]), "|").alias("roles"),
                    F.md5(F.array_join(F.transform(chat, lambda m: m["content"]), "\n")).alias("chat_md5"))


# Every third conversation brings its turns as ready messages; the others are built from a question and its answer's
# reasoning, stored as a model response (every fifth is no response at all).
@query("e_chat_reasoning", f"""
WITH p AS (SELECT a.conv_id, a.turn, u.text AS q, a.text AS a FROM conversations a JOIN conversations u
           ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant')
SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'user|assistant' WHEN conv_id % 5 = 0 THEN 'system|user' ELSE 'system|user|assistant' END AS roles,
       md5(CASE WHEN conv_id % 3 = 0 THEN q || {NL} || a
                ELSE '{SYSTEM_TEXT}' || {NL} || q || CASE WHEN conv_id % 5 = 0 THEN '' ELSE {NL} || '<think>' || a || ' Final Results, then ' END END) AS chat_md5
FROM p""")
def e_chat_reasoning(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    p = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("a")).join(u, ["conv_id", "turn"])
    said = F.struct(F.concat("a", F.lit(" Final Results, then Final Results: yes")).alias("content"))
    response = F.to_json(F.struct(F.array(F.struct(said.alias("message"))).alias("choices")))
    raw = F.when(F.col("conv_id") % 5 == 0, F.lit("no response")).otherwise(response)
    ready = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")),
                                                      F.struct(F.lit("assistant").alias("role"), F.col("a").alias("content"))))
    chat = rd.build_chat(F.col("q"), F.lit(SYSTEM_TEXT), rd.reasoning_prefix(raw), ready)
    return p.select("conv_id", "turn", F.array_join(F.transform(chat, lambda m: m["role"]), "|").alias("roles"),
                    F.md5(F.array_join(F.transform(chat, lambda m: m["content"]), "\n")).alias("chat_md5"))


# The code book of a disabled kind, from the parts: code and short description.
@query("e_lookup_hcpcs", """
SELECT l_orderkey, l_linenumber, 'H' || CAST(l_partkey AS VARCHAR) AS hcpcs_cd, CASE WHEN p_size <= 40 THEN p_name END AS short_description
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def e_lookup_hcpcs(spark, sf):
    book = table(spark, sf, "part").where(F.col("p_size") <= 40).select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("hcpcs_cd"), F.col("p_name").alias("short_description"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("hcpcs_cd"))
    return lk.lookup_item(rows, book, "hcpcs_cd", "short_description").select("l_orderkey", "l_linenumber", "hcpcs_cd", "short_description")


@query("e_unwrap", """
SELECT conv_id, turn, md5(text) AS text_md5, length(text) AS text_len FROM conversations""")
def e_unwrap(spark, sf):
    c = table(spark, sf, "conversations")
    raw = (F.when(F.col("role") == "user", F.to_json(F.array("text")))
           .when(F.col("role") == "assistant", F.to_json(F.struct(F.array(F.struct(F.struct(
               F.col("text").alias("content")).alias("message"))).alias("choices"))))
           .otherwise(F.col("text")))
    u = rd.unwrap_reasoning(raw)
    return c.select("conv_id", "turn", F.md5(u).alias("text_md5"), F.length(u).cast("bigint").alias("text_len"))


@query("e_truncate_left", """
SELECT doc_id, md5(array_to_string(list_slice(w, greatest(1, len(w) - 512 + 1), len(w)), ' ')) AS tail_md5,
       least(len(w), 512) AS n_tokens
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def e_truncate_left(spark, sf):
    d = table(spark, sf, "documents")
    t = truncate_left("text", 512)
    return d.select("doc_id", F.md5(t).alias("tail_md5"),
                    F.least(F.size(F.split("text", " ")), F.lit(512)).cast("bigint").alias("n_tokens"))
