"""A/B family queries on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us, normalize_time, normalize_visit
from tidemark.operators import timeline as tl
from tidemark.plans import bindings as b
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.sources.tables import table

ROW_OUT = ["subject_id", "row_id", "file_name", "source_rank", "ts_us", "hadm_id", "end_us", "dod_us", "k",
           "target_text", "icd_version", "icd_code"]


@query("a_event_union", ctes("o_drows") + f"SELECT {', '.join(ROW_OUT)} FROM o_drows")
def a_event_union(spark, sf):
    return b.decoded_rows(spark, sf).select(*ROW_OUT)


@query("b_timeline_order", ctes("o_timeline") + "SELECT subject_id, row_id, file_name, pos FROM o_timeline")
def b_timeline_order(spark, sf):
    return b.marked_rows(spark, sf).select("subject_id", "row_id", "file_name", "pos")


@query("b_place_untimed", ctes("o_timeline") + """
SELECT subject_id, row_id, file_name, pos, prev_kind FROM (
  SELECT *, lag(file_name) OVER (PARTITION BY subject_id ORDER BY pos) AS prev_kind FROM o_timeline)
WHERE file_name IN ('diagnoses_icd', 'drgcodes')""")
def b_place_untimed(spark, sf):
    # the previous row by position: an equi-join on (subject, pos - 1), no subject window
    t = b.marked_rows(spark, sf)
    prev = t.select("subject_id", (F.col("pos") + 1).alias("pos"), F.col("file_name").alias("prev_kind"))
    return (t.where(F.col("file_name").isin("diagnoses_icd", "drgcodes"))
            .join(prev, ["subject_id", "pos"], "left")
            .select("subject_id", "row_id", "file_name", "pos", "prev_kind"))


@query("b_runs", ctes("o_events") + "SELECT subject_id, event_idx, file_name, n_items, first_pos FROM o_events")
def b_runs(spark, sf):
    return b.events(spark, sf).select("subject_id", "event_idx", "file_name", "n_items", "first_pos")



@query("b_run_times", ctes("o_events") + """
SELECT subject_id, event_idx, hadm_id, starttime_us, endtime_us, end_us, dod_us FROM o_events""")
def b_run_times(spark, sf):
    return b.events(spark, sf).select("subject_id", "event_idx", "hadm_id", "starttime_us", "endtime_us",
                                      "end_us", "dod_us")


@query("b_run_items", ctes("o_marked") + """
SELECT subject_id, event_idx, string_agg(CAST(row_id AS VARCHAR), '|' ORDER BY pos) AS item_rows,
       string_agg(coalesce(target_text, ''), '|' ORDER BY pos) AS item_texts
FROM o_marked GROUP BY subject_id, event_idx""")
def b_run_items(spark, sf):
    items = tl.run_items(b.marked_rows(spark, sf), ["row_id", "target_text"], marked=True)
    return items.select(
        "subject_id", "event_idx",
        F.array_join(F.transform("items", lambda i: i["row_id"].cast("string")), "|").alias("item_rows"),
        F.array_join(F.transform("items", lambda i: F.coalesce(i["target_text"], F.lit(""))), "|").alias("item_texts"))


# B12 / B13 inputs: texts derived from the events table in several shapes.
_TIME_TEXT_SQL = """CASE event_type WHEN 'signup' THEN strftime(ts, '%Y-%m-%d')
                    WHEN 'error' THEN 'n/a' WHEN 'click' THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
                    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"""


@query("b_norm_time", f"""
SELECT event_id, epoch_us(CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN strptime(t, '%Y-%m-%d')
                              WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}$')
                              THEN strptime(t, '%Y-%m-%d %H:%M:%S') END) AS norm_us
FROM (SELECT event_id, {_TIME_TEXT_SQL} AS t FROM events)""")
def b_norm_time(spark, sf):
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    text = (F.when(et == "signup", F.date_format("ts", "yyyy-MM-dd")).when(et == "error", F.lit("n/a"))
            .when(et == "click", F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return ev.select("event_id", normalize_time(text).alias("norm_us"))


@query("b_norm_visit", """
SELECT event_id, CASE WHEN t IS NULL OR lower(t) = 'nan' OR t = 'None' THEN NULL
                      ELSE CAST(TRY_CAST(t AS DOUBLE) AS BIGINT) END AS visit_id
FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'nan' WHEN 'error' THEN 'None'
                           WHEN 'click' THEN CAST(user_id * 1000 AS VARCHAR)
                           ELSE CAST(user_id * 1000 AS VARCHAR) || '.0' END AS t FROM events)""")
def b_norm_visit(spark, sf):
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    text = (F.when(et == "signup", F.lit("nan")).when(et == "error", F.lit("None"))
            .when(et == "click", (F.col("user_id") * 1000).cast("string"))
            .otherwise(F.concat((F.col("user_id") * 1000).cast("string"), F.lit(".0"))))
    return ev.select("event_id", normalize_visit(text).alias("visit_id"))


@query("b_order_notes", """
SELECT user_id AS subject_id, event_id AS row_id,
       row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), CAST(props ->> '$.k' AS INTEGER), event_id) AS pos
FROM events WHERE event_type = 'signup'""")
def b_order_notes(spark, sf):
    notes = (table(spark, sf, "events").where(F.col("event_type") == "signup")
             .select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("row_id"),
                     epoch_us("ts").alias("ts_us"), F.get_json_object("props", "$.k").cast("int").alias("note_seq")))
    return tl.order_notes(notes, keys=("row_id",)).select("subject_id", "row_id", "pos")


cte("o_stays", (), """
  SELECT o_orderkey AS stay_id, o_custkey AS subject_id, epoch_us(o_orderdate) AS intime_us,
         o_custkey * 10000 + year(o_orderdate) AS hadm_id,
         (SELECT max(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) AS outtime_us
  FROM orders""")
cte("o_stay_rows", ("o_stays",), """
  SELECT subject_id, hadm_id, stay_id, 'edstays' AS file_name, intime_us AS ts_us, 0 AS l_linenumber,
         CAST(0 AS BIGINT) AS l_partkey, CAST(0 AS BIGINT) AS l_suppkey FROM o_stays
  UNION ALL
  SELECT subject_id, hadm_id, stay_id, 'triage', NULL, 0, 0, 0 FROM o_stays
  UNION ALL
  SELECT s.subject_id, s.hadm_id, s.stay_id,
         CASE WHEN l_returnflag = 'R' THEN 'diagnosis' WHEN l_linestatus = 'O' THEN 'pyxis' ELSE 'vitalsign' END,
         CASE WHEN l_returnflag <> 'R' THEN epoch_us(l_shipdate) END, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN o_stays s ON s.stay_id = l_orderkey""")

_ROW_KEYS = ("l_linenumber", "l_partkey", "l_suppkey")


@query("b_synth_times", ctes("o_stay_rows") + """
SELECT r.stay_id, r.file_name, r.l_linenumber, r.l_partkey, r.l_suppkey,
       CASE WHEN r.file_name = 'triage' THEN s.intime_us + 1000000
            WHEN r.file_name = 'diagnosis' THEN s.outtime_us ELSE r.ts_us END AS ts_us
FROM o_stay_rows r JOIN o_stays s USING (stay_id)""")
def b_synth_times(spark, sf):
    rows, stays = b.stay_rows(spark, sf)
    return tl.synth_ed_times(rows, stays).select("stay_id", "file_name", *_ROW_KEYS, "ts_us")


@query("b_order_ed", ctes("o_stay_rows") + """
SELECT subject_id, stay_id, file_name, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY subject_id ORDER BY stay_id,
          CASE WHEN file_name IN ('edstays', 'triage') THEN 0 WHEN file_name = 'diagnosis' THEN 2 ELSE 1 END,
          CASE WHEN file_name NOT IN ('edstays', 'triage', 'diagnosis') THEN ts_us END NULLS FIRST,
          CASE file_name WHEN 'edstays' THEN 0 WHEN 'triage' THEN 1 WHEN 'medrecon' THEN 2 WHEN 'pyxis' THEN 3
                         WHEN 'vitalsign' THEN 4 WHEN 'diagnosis' THEN 5 END,
          l_linenumber, l_partkey, l_suppkey) AS pos
FROM o_stay_rows""")
def b_order_ed(spark, sf):
    rows, _ = b.stay_rows(spark, sf)
    return tl.order_ed(rows, keys=_ROW_KEYS).select("subject_id", "stay_id", "file_name", *_ROW_KEYS, "pos")


@query("b_order_icu", ctes("o_stay_rows") + """
SELECT subject_id, hadm_id, stay_id, kind, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (PARTITION BY subject_id ORDER BY hadm_id, stay_id,
          CASE WHEN kind = 'icustays' THEN 0 ELSE 1 END, ts_us NULLS FIRST, l_linenumber, l_partkey, l_suppkey) AS pos
FROM (SELECT *, CASE WHEN file_name = 'edstays' THEN 'icustays' ELSE 'chartevents' END AS kind
      FROM o_stay_rows WHERE file_name <> 'triage')""")
def b_order_icu(spark, sf):
    rows, _ = b.stay_rows(spark, sf)
    icu = (rows.where(F.col("file_name") != "triage")
           .withColumn("kind", F.when(F.col("file_name") == "edstays", F.lit("icustays")).otherwise(F.lit("chartevents"))))
    return (tl.order_icu(icu, kind="kind", keys=_ROW_KEYS)
            .select("subject_id", "hadm_id", "stay_id", "kind", *_ROW_KEYS, "pos"))


@query("b_merge_stays", ctes("o_stay_rows") + """
SELECT hadm_id, stay_id, max(CASE WHEN file_name = 'edstays' THEN ts_us END) AS stay_us,
       count(*) FILTER (WHERE file_name <> 'edstays') AS n_sub,
       string_agg(file_name || ':' || CAST(l_linenumber AS VARCHAR), '|' ORDER BY pos)
         FILTER (WHERE file_name <> 'edstays') AS sub_rows
FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY ts_us NULLS FIRST, file_name, l_linenumber,
                                   l_partkey, l_suppkey) AS pos FROM o_stay_rows)
GROUP BY hadm_id, stay_id""")
def b_merge_stays(spark, sf):
    rows, _ = b.stay_rows(spark, sf)
    rows = tl.order_within(rows, ["stay_id"], [F.col("ts_us"), F.col("file_name"), *[F.col(c) for c in _ROW_KEYS]])
    m = tl.merge_stays(rows, "hadm_id", "stay_id", "edstays", payload=["ts_us", "l_linenumber"])
    subs = F.filter("sub_rows", lambda x: x.isNotNull())
    return m.select("hadm_id", "stay_id", F.col("stay.ts_us").alias("stay_us"), F.size(subs).cast("bigint").alias("n_sub"),
                    F.when(F.size(subs) > 0, F.array_join(F.transform(
                        subs, lambda x: F.concat(x["kind"], F.lit(":"), x["l_linenumber"].cast("string"))), "|"))
                    .alias("sub_rows"))


@query("b_len_filter", ctes("o_events") + """
SELECT subject_id, count(*) AS n_events FROM o_events GROUP BY subject_id HAVING count(*) BETWEEN 50 AND 70""")
def b_len_filter(spark, sf):
    ev = tl.event_count_filter(b.events(spark, sf), 50, 70)
    return ev.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_events"))
