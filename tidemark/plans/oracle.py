"""DuckDB SQL twins of the bindings, written independently of the Spark code.

``ctes(*names)`` returns a ``WITH`` prefix containing the named building blocks
(and their dependencies) so that every oracle query reads only the given tables.
"""

from __future__ import annotations

import re

_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    _CTE[name] = (deps, sql)


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in _CTE[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n][1]})" for n in _order(names)) + "\n"


cte("o_base", (), """
  SELECT user_id AS subject_id, event_id AS row_id,
         CASE event_type WHEN 'purchase' THEN 'admissions' WHEN 'error' THEN 'edstays'
              WHEN 'click' THEN 'icustays' WHEN 'view' THEN 'labevents' WHEN 'signup' THEN 'discharge' END AS file_name,
         epoch_us(ts) AS ts_us,
         CASE WHEN event_type <> 'signup'
              THEN user_id * 100 + CAST(floor((epoch_us(ts) - 1704067200000000) / 604800000000.0) AS BIGINT) END AS hadm_id,
         value, CAST(props ->> '$.k' AS INTEGER) AS k, event_type
  FROM events""")

cte("o_rows", ("o_base",), """
  SELECT subject_id, row_id, file_name, ts_us, hadm_id,
         CASE WHEN file_name IN ('admissions', 'icustays') THEN ts_us + CAST(floor(value * 3600000000.0) AS BIGINT)
              WHEN file_name = 'edstays' THEN ts_us + CAST(floor(value * 600000000.0) AS BIGINT) END AS end_us,
         CAST(NULL AS BIGINT) AS dod_us, k, value,
         CASE WHEN file_name = 'admissions' THEN (CASE WHEN k <= 33 THEN 'EMERGENCY' WHEN k <= 66 THEN 'URGENT' ELSE 'ELECTIVE' END)
              WHEN file_name = 'discharge' THEN 'discharge note ' || CAST(k AS VARCHAR) END AS target_text,
         CAST(NULL AS VARCHAR) AS icd_version, CAST(NULL AS VARCHAR) AS icd_code
  FROM o_base
  UNION ALL
  SELECT subject_id, row_id, 'diagnoses_icd', NULL, hadm_id, NULL, NULL, k, value, NULL,
         CASE WHEN value > 50 THEN '10' ELSE '9' END, CAST(k AS VARCHAR)
  FROM o_base WHERE event_type = 'purchase'
  UNION ALL
  SELECT subject_id, row_id, 'drgcodes', NULL, hadm_id, NULL, NULL, k, value, NULL, NULL, NULL
  FROM o_base WHERE event_type = 'purchase' AND value > 100
  UNION ALL
  SELECT subject_id, -1, 'patients', NULL, NULL, NULL,
         CASE WHEN arg_max(file_name, ts_us) IN ('edstays', 'icustays')
              THEN CAST(floor(max(ts_us) / 86400000000.0) AS BIGINT) * 86400000000 END,
         NULL, NULL, NULL, NULL, NULL
  FROM o_base GROUP BY subject_id""")

cte("o_icd", (), """
  SELECT '9' AS icd_version, CAST(p_partkey AS VARCHAR) AS icd_code, 'condition ' || p_name AS long_title FROM part
  UNION ALL
  SELECT '10', CAST(p_partkey AS VARCHAR), 'disorder ' || lower(p_type) FROM part""")

cte("o_drows", ("o_rows", "o_icd"), """
  SELECT r.subject_id, r.row_id, r.file_name,
         CASE WHEN r.file_name IN ('admissions', 'labevents', 'diagnoses_icd', 'drgcodes', 'patients') THEN 0
              WHEN r.file_name = 'discharge' THEN 1 WHEN r.file_name = 'edstays' THEN 2 ELSE 3 END AS source_rank,
         r.ts_us, r.hadm_id, r.end_us, r.dod_us, r.k, r.value,
         CASE WHEN r.file_name = 'labevents' THEN p.p_name
              WHEN r.file_name = 'diagnoses_icd' THEN d.long_title ELSE r.target_text END AS target_text,
         r.icd_version, r.icd_code
  FROM o_rows r
  LEFT JOIN part p ON p.p_partkey = r.k
  LEFT JOIN o_icd d ON d.icd_version = r.icd_version AND d.icd_code = r.icd_code""")

cte("o_tpos", ("o_drows",), """
  SELECT *,
         CASE WHEN ts_us IS NOT NULL AND file_name NOT IN ('patients', 'diagnoses_icd', 'drgcodes')
              THEN row_number() OVER (PARTITION BY subject_id,
                     (ts_us IS NOT NULL AND file_name NOT IN ('patients', 'diagnoses_icd', 'drgcodes'))
                   ORDER BY ts_us, source_rank, file_name, row_id) END AS tpos
  FROM o_drows""")

cte("o_timeline", ("o_tpos",), """
  SELECT * EXCLUDE (tpos, anchor),
         row_number() OVER (PARTITION BY subject_id ORDER BY
             CASE WHEN file_name = 'patients' THEN 0 WHEN anchor IS NOT NULL THEN 1 ELSE 2 END,
             anchor NULLS FIRST,
             CASE WHEN tpos IS NOT NULL THEN 0 WHEN file_name = 'diagnoses_icd' THEN 1
                  WHEN file_name = 'drgcodes' THEN 2 ELSE 3 END,
             row_id, file_name) AS pos
  FROM (SELECT *, CASE WHEN tpos IS NOT NULL THEN tpos
                       WHEN file_name IN ('diagnoses_icd', 'drgcodes') THEN max(tpos) OVER (PARTITION BY subject_id, hadm_id)
                  END AS anchor
        FROM o_tpos)""")

cte("o_marked", ("o_timeline",), """
  SELECT *, CAST(sum(CASE WHEN prev_kind IS NULL OR prev_kind <> file_name THEN 1 ELSE 0 END)
              OVER (PARTITION BY subject_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS event_idx
  FROM (SELECT *, lag(file_name) OVER (PARTITION BY subject_id ORDER BY pos) AS prev_kind FROM o_timeline)""")

cte("o_events", ("o_marked",), """
  SELECT subject_id, event_idx, file_name, hadm_id, n_items, first_pos, end_us, dod_us,
         CASE WHEN file_name NOT IN ('patients', 'diagnoses_icd', 'drgcodes') THEN s END AS starttime_us,
         CASE WHEN file_name NOT IN ('patients', 'diagnoses_icd', 'drgcodes') THEN e END AS endtime_us
  FROM (SELECT subject_id, event_idx,
               first(file_name ORDER BY pos) AS file_name, first(hadm_id ORDER BY pos) AS hadm_id,
               first(ts_us ORDER BY pos) FILTER (WHERE ts_us IS NOT NULL) AS s, max(ts_us) AS e,
               count(*) AS n_items, min(pos) AS first_pos,
               first(end_us ORDER BY pos) AS end_us, first(dod_us ORDER BY pos) AS dod_us
        FROM o_marked GROUP BY subject_id, event_idx)""")

# --- C family: written as correlated look-ups (an independent formulation) ---
cte("o_ev", ("o_events",), """
  SELECT e.*, max(dod_us) OVER (PARTITION BY subject_id) AS dod,
         CASE WHEN file_name = 'diagnoses_icd'
              THEN lag(starttime_us) OVER (PARTITION BY subject_id ORDER BY event_idx) ELSE starttime_us END AS t_back,
         starttime_us AS t_fwd
  FROM o_events e""")

cte("o_prep0", ("o_ev",), """
  SELECT a.*,
    (SELECT min(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx >= 1
        AND b.event_idx < a.event_idx AND b.hadm_id IS NOT DISTINCT FROM a.hadm_id
        AND a.t_back - b.t_back < 86400000000) AS ctx_begin,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.hadm_id IS NOT DISTINCT FROM a.hadm_id AND b.t_fwd - a.t_fwd < 86400000000) AS ctx_last,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.hadm_id = a.hadm_id AND b.t_fwd - a.t_fwd < 86400000000) AS ctx_last_icu,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.t_fwd < a.end_us) AS ctx_until,
    (SELECT min(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.file_name = 'admissions' AND b.hadm_id = a.hadm_id) AS adm_next_same,
    (SELECT min(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.file_name = 'icustays' AND b.hadm_id = a.hadm_id) AS icu_next_same,
    (SELECT min(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.file_name = 'edstays') AS ed_next,
    (SELECT min(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.file_name = 'admissions') AS adm_next,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx > a.event_idx
        AND b.hadm_id = a.hadm_id AND b.t_fwd IS NOT NULL) AS liv_idx,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx <= a.event_idx
        AND b.file_name = 'admissions') AS adm_asof,
    (SELECT max(b.event_idx) FROM o_ev b WHERE b.subject_id = a.subject_id AND b.event_idx <= a.event_idx
        AND b.file_name = 'discharge') AS dis_asof
  FROM o_ev a""")

cte("o_prep", ("o_prep0",), """
  SELECT p.*,
    cl.t_fwd AS ctx_last_us, ci.t_fwd AS ctx_last_icu_us, an.t_fwd AS adm_next_same_us,
    inx.t_fwd AS icu_next_same_us, en.t_fwd AS ed_next_us, ax.t_fwd AS adm_next_us, lv.t_fwd AS last_in_visit_us,
    CASE WHEN aa.hadm_id = p.hadm_id THEN p.adm_asof END AS admissions_id,
    CASE WHEN p.dis_asof IS NOT NULL AND (p.hadm_id IS NULL OR dd.hadm_id IS NULL OR dd.hadm_id <> p.hadm_id)
         THEN p.dis_asof END AS last_discharge_id
  FROM o_prep0 p
  LEFT JOIN o_ev cl ON cl.subject_id = p.subject_id AND cl.event_idx = p.ctx_last
  LEFT JOIN o_ev ci ON ci.subject_id = p.subject_id AND ci.event_idx = p.ctx_last_icu
  LEFT JOIN o_ev an ON an.subject_id = p.subject_id AND an.event_idx = p.adm_next_same
  LEFT JOIN o_ev inx ON inx.subject_id = p.subject_id AND inx.event_idx = p.icu_next_same
  LEFT JOIN o_ev en ON en.subject_id = p.subject_id AND en.event_idx = p.ed_next
  LEFT JOIN o_ev ax ON ax.subject_id = p.subject_id AND ax.event_idx = p.adm_next
  LEFT JOIN o_ev lv ON lv.subject_id = p.subject_id AND lv.event_idx = p.liv_idx
  LEFT JOIN o_ev aa ON aa.subject_id = p.subject_id AND aa.event_idx = p.adm_asof
  LEFT JOIN o_ev dd ON dd.subject_id = p.subject_id AND dd.event_idx = p.dis_asof""")

cte("o_targets", ("o_marked",), """
  SELECT subject_id, event_idx, task, target FROM (
    SELECT subject_id, event_idx, file_name AS task,
           CASE WHEN file_name = 'discharge'
                THEN CASE WHEN count(*) FILTER (WHERE target_text IS NOT NULL AND target_text <> '') = 1
                          THEN first(target_text ORDER BY pos) FILTER (WHERE target_text IS NOT NULL AND target_text <> '') END
                ELSE string_agg(DISTINCT trim(target_text), '|' ORDER BY trim(target_text))
                       FILTER (WHERE trim(target_text) <> '') END AS target
    FROM o_marked WHERE file_name IN ('admissions', 'labevents', 'diagnoses_icd', 'discharge')
    GROUP BY subject_id, event_idx, file_name)
  WHERE target IS NOT NULL""")

_SAMPLE = "subject_id, hadm_id, {task} AS task, file_name AS event, event_idx, {b} AS context_begin, {e} AS context_end, {y} AS target, admissions_id, last_discharge_id"


def _yn(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'yes' ELSE 'no' END"


def _risk(task: str, cond: str, where: str, b: str, e: str, guard: str = "TRUE") -> str:
    return (f"SELECT {_SAMPLE.format(task=repr(task), b=b, e=e, y=_yn(cond))} FROM o_prep "
            f"WHERE {where} AND {guard}")


_ED = "file_name = 'edstays' AND ctx_until IS NOT NULL"
_ED_MORT = "(dod IS NOT NULL AND last_in_visit_us IS NOT NULL AND NOT (last_in_visit_us < dod))"
_ED_ICU = "(icu_next_same IS NOT NULL AND icu_next_same_us - end_us < 43200000000)"
_ADM = "file_name = 'admissions' AND ctx_last IS NOT NULL"
_ICU = "file_name = 'icustays' AND ctx_last_icu IS NOT NULL"
_DIS = "file_name = 'discharge' AND ctx_begin IS NOT NULL"
_H = 3600000000

_RISK_PARTS = [
    _risk("ED_Hospitalization", "adm_next_same IS NOT NULL", _ED, "event_idx", "ctx_until + 1"),
    _risk("ED_Inpatient_Mortality", _ED_MORT, _ED, "event_idx", "ctx_until + 1"),
    _risk("ED_ICU_Tranfer_12hour", _ED_ICU, _ED, "event_idx", "ctx_until + 1"),
    _risk("ED_Reattendance_3day", f"ed_next IS NOT NULL AND ed_next_us - end_us < {72 * _H}", _ED, "event_idx",
          "ctx_until + 1"),
    _risk("ED_Critical_Outcomes", f"{_ED_ICU} OR {_ED_MORT}", _ED, "event_idx", "ctx_until + 1"),
    _risk("LengthOfStay_3day", f"end_us - t_fwd > {72 * _H}", _ADM, "event_idx", "ctx_last + 1",
          "ctx_last_us < end_us"),
    _risk("LengthOfStay_7day", f"end_us - t_fwd > {168 * _H}", _ADM, "event_idx", "ctx_last + 1",
          "ctx_last_us < end_us"),
    _risk("Inpatient_Mortality", "dod IS NOT NULL AND NOT (end_us < dod)", _ADM, "event_idx", "ctx_last + 1"),
] + [
    _risk(f"ICU_Mortality_{d}day", f"dod IS NOT NULL AND dod - ctx_last_icu_us < {d * 24 * _H}", _ICU, "event_idx",
          "ctx_last_icu + 1") for d in (1, 2, 3, 7, 14)
] + [
    _risk(f"ICU_Stay_{d}day", f"NOT coalesce(end_us - t_fwd < {d * 24 * _H}, FALSE)", _ICU, "event_idx",
          "ctx_last_icu + 1") for d in (7, 14)
] + [
    _risk("ICU_Readmission", "icu_next_same IS NOT NULL", _ICU, "event_idx", "ctx_last_icu + 1"),
    _risk("Readmission_30day", f"adm_next IS NOT NULL AND adm_next_us - t_fwd < {720 * _H}", _DIS, "ctx_begin",
          "event_idx + 1"),
    _risk("Readmission_60day", f"adm_next IS NOT NULL AND adm_next_us - t_fwd < {1440 * _H}", _DIS, "ctx_begin",
          "event_idx + 1"),
]

cte("o_risk", ("o_prep",), "\n  UNION ALL\n  ".join(_RISK_PARTS))

_CONFIGURED = ("'patients', 'omr', 'pharmacy', 'poe', 'procedures_icd', 'prescriptions', 'services', 'labevents', "
               "'microbiologyevents', 'admissions', 'transfers', 'emar', 'diagnoses_icd', 'radiology', 'discharge', "
               "'edstays', 'triage', 'medrecon', 'pyxis', 'vitalsign', 'diagnosis', 'icustays', 'chartevents', "
               "'ingredientevents', 'datetimeevents', 'procedureevents', 'inputevents', 'outputevents'")

cte("o_decision", ("o_prep", "o_targets"), f"""
  SELECT p.subject_id, p.hadm_id, t.task, p.file_name AS event, p.event_idx, p.ctx_begin AS context_begin,
         p.event_idx AS context_end, t.target, p.admissions_id, p.last_discharge_id
  FROM o_prep p JOIN o_targets t USING (subject_id, event_idx)
  WHERE p.ctx_begin IS NOT NULL
  UNION ALL
  SELECT subject_id, hadm_id, 'next_event', file_name, event_idx, ctx_begin, event_idx, file_name,
         admissions_id, last_discharge_id
  FROM o_prep WHERE ctx_begin IS NOT NULL AND t_back IS NOT NULL AND file_name IN ({_CONFIGURED})""")

cte("o_index", ("o_decision", "o_risk"), "SELECT * FROM o_decision UNION ALL SELECT * FROM o_risk")


# --- the same chain on rows of every configured kind that has a decision task (see bindings.record_rows) ---
from tidemark.plans.bindings import RECORD_KINDS, RECORD_SOURCE  # noqa: E402
from tidemark.spec import TASKS  # noqa: E402

_CHAIN = ("o_drows", "o_tpos", "o_timeline", "o_marked", "o_events", "o_ev", "o_prep0", "o_prep", "o_targets", "o_risk", "o_decision", "o_index")


def recorded(sql: str) -> str:
    """The text with the chain's blocks replaced by those on all kinds."""
    return re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_rec", sql)


_KIND = "[" + ", ".join(f"'{k}'" for k in RECORD_KINDS) + f"][k % {len(RECORD_KINDS)} + 1]"
cte("o_drows_rec", ("o_drows",), f"""
  SELECT * REPLACE (CASE {" ".join(f"WHEN file_name = '{k}' THEN {n}" for k, n in RECORD_SOURCE.items())} ELSE source_rank END AS source_rank)
  FROM (SELECT * REPLACE (CASE WHEN file_name = 'labevents' THEN {_KIND} ELSE file_name END AS file_name) FROM o_drows)""")
for _name in _CHAIN[1:]:
    if _name != "o_targets":
        cte(f"{_name}_rec", tuple(recorded(d) for d in _CTE[_name][0]), recorded(_CTE[_name][1]))
cte("o_targets_rec", ("o_marked_rec",), f"""
  SELECT subject_id, event_idx, task, target FROM (
    SELECT subject_id, event_idx, task, CASE WHEN task <> 'discharge' THEN string_agg(DISTINCT trim(v), '|' ORDER BY trim(v))
                                             WHEN count(*) = 1 THEN min(v) END AS target
    FROM (SELECT subject_id, event_idx, task, unnest(
            CASE WHEN task = 'radiology' THEN [p_brand, p_type]
                 WHEN task = 'transfers' THEN [CASE WHEN value > 100 THEN p_type ELSE p_brand END]
                 WHEN target_key IN ('CCS Type', 'ATC Type') THEN [p_brand]
                 ELSE [CASE WHEN value < 10 THEN 'nan' ELSE ' ' || p_name END] END) AS v
          FROM o_marked_rec JOIN part ON p_partkey = k
          JOIN (VALUES {", ".join(f"('{t.task}', '{t.event}', '{t.target_key}')" for t in TASKS if t.task_type == "decision_making" and t.event != "any")})
               t(task, file_name, target_key) USING (file_name))
    WHERE v <> 'nan' GROUP BY subject_id, event_idx, task) WHERE target IS NOT NULL""")
