"""OMOP-shaped queries (E11-E14, A19, A20) bound to orders / lineitem / customer.

Rows per patient (customer): one person row (segment code), lineitems with status F
as measurements (LOINC-like code from the part, quantity as value), status O as
conditions (return flag R) or drug exposures, urgent orders as notes. Every order
is a sample whose context runs from the first row through the last row at or
before the order date. Code books and reference ranges are built by rule from
part / supplier / customer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.time import epoch_us
from tidemark.operators import omop as om
from tidemark.operators.ordering import running_sums
from tidemark.operators.timeline import order_within
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.session import drop_stages, staged, stages_written
from tidemark.sources.tables import table

PERSON_START_US = 631152000000000  # 1990-01-01 00:00:00


def rows(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    person = c.select(F.col("c_custkey").alias("patient_id"), F.lit("person").alias("omop_table"),
                      F.concat(F.lit("SEG/"), "c_mktsegment").alias("code"), F.lit(None).cast("string").alias("value"),
                      F.lit(None).cast("string").alias("unit"), F.lit(PERSON_START_US).cast("bigint").alias("start_us"),
                      F.lit(0).cast("bigint").alias("k1"), F.lit(0).alias("k2"))
    tbl = (F.when(F.col("l_linestatus") == "F", F.lit("measurement"))
           .when(F.col("l_returnflag") == "R", F.lit("condition_occurrence")).otherwise(F.lit("drug_exposure")))
    code = (F.when(F.col("l_linestatus") == "F", F.concat(F.lit("LOINC/"), F.col("l_suppkey").cast("string")))
            .when(F.col("l_returnflag") == "R", F.concat(F.lit("ICD10CM/"), F.col("l_suppkey").cast("string")))
            .otherwise(F.concat(F.lit("RxNorm/"), F.col("l_partkey").cast("string"))))
    meas = F.col("l_linestatus") == "F"
    value = F.when(meas & (F.col("l_discount") != 0), F.format_string("%.1f", F.col("l_quantity")))
    items = li.select(F.col("o_custkey").alias("patient_id"), tbl.alias("omop_table"), code.alias("code"),
                      value.alias("value"), F.when(meas, F.lit("mg")).alias("unit"),
                      epoch_us("l_shipdate").alias("start_us"), F.col("l_orderkey").alias("k1"),
                      F.col("l_linenumber").alias("k2"))
    notes = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("patient_id"), F.lit("note").alias("omop_table"), F.lit("NOTE").alias("code"),
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"),
        epoch_us("o_orderdate").alias("start_us"), F.col("o_orderkey").alias("k1"), F.lit(0).alias("k2"))
    before = stages_written()
    allr = staged(person.unionByName(items).unionByName(notes))  # the shuffles of the join go before those of the ordering come
    order = [F.col("start_us"), F.col("omop_table"), F.col("code"), F.col("value").asc_nulls_first(), F.col("k1"),
             F.col("k2")]
    ordered = order_within(allr, ["patient_id"], order, write=staged, drop=("k1", "k2")).withColumn("pos", F.col("pos") - 1)
    drop_stages(spark, before, ordered)
    return ordered


def samples(spark, sf, prow):
    """Orders as samples; period_end = (rows at or before the order date) - 1.

    In the merged time order (rows before probes at equal times) the rows ahead of a probe are counted;
    only the probes are written."""
    o = table(spark, sf, "orders")
    probes = o.select(F.col("o_custkey").alias("patient_id"), epoch_us("o_orderdate").alias("t"),
                      F.lit(1).alias("probe"), F.col("o_orderkey").alias("sample_id"),
                      F.when(F.col("o_orderstatus") == "F", F.lit("lab_hyperkalemia"))
                      .when(F.col("o_orderstatus") == "O", F.lit("guo_readmission")).otherwise(F.lit("new_pancan"))
                      .alias("task_name"),
                      F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"))
    cands = prow.select("patient_id", F.col("start_us").alias("t"), F.lit(0).alias("probe"),
                        (-F.col("pos") - 1).alias("sample_id"))
    ranked = running_sums(probes.unionByName(cands, allowMissingColumns=True), ["patient_id"], [F.col("t"), F.col("probe"), F.col("sample_id")],
                          {"n_rows": F.col("probe") == 0}, F.col("probe") == 1)
    lab = F.col("task_name").startswith("lab_")
    low = F.col("price") < 150000
    return ranked.select(
        "sample_id", "patient_id", "task_name",
        F.when(lab, F.when(low, F.lit("normal")).otherwise(F.lit("abnormal")))
         .otherwise(F.when(low, F.lit("True")).otherwise(F.lit("False"))).alias("label"),
        F.lit(0).cast("bigint").alias("period_begin"), (F.col("n_rows") - 1).alias("period_end"),
        F.when(F.col("prio") == "5-LOW", F.lit("val")).when(F.col("prio") == "4-NOT SPECIFIED", F.lit(None))
         .otherwise(F.lit("train")).alias("split"))


def books(spark, sf):
    p, s, c = table(spark, sf, "part"), table(spark, sf, "supplier"), table(spark, sf, "customer")
    code_map = (c.select(F.concat(F.lit("SEG/"), "c_mktsegment").alias("code"),
                         F.concat(F.lit("segment "), F.lower("c_mktsegment")).alias("description")).distinct()
                .unionByName(s.select(F.concat(F.lit("LOINC/"), F.col("s_suppkey").cast("string")).alias("code"),
                                      F.concat(F.lit("lab "), "s_name").alias("description")))
                .unionByName(p.select(F.concat(F.lit("RxNorm/"), F.col("p_partkey").cast("string")).alias("code"),
                                      F.when(F.col("p_size") > 40, F.concat(F.lit("ICD10PCS/"), F.col("p_partkey").cast("string")))
                                      .otherwise(F.concat_ws(" ", F.lower("p_type"), F.col("p_name"))).alias("description")))
                .unionByName(s.select(F.concat(F.lit("ICD10CM/"), F.col("s_suppkey").cast("string")).alias("code"),
                                      F.when(F.col("s_acctbal") < 0, F.concat(F.lit("CPT4/"), F.col("s_suppkey").cast("string")))
                                      .otherwise(F.concat(F.lit("condition "), F.col("s_name"))).alias("description"))))
    cpt4 = s.where(F.col("s_nationkey") < 10).select(F.col("s_suppkey").cast("string").alias("code"),
                                                      F.concat(F.lit("procedure "), F.col("s_name")).alias("description"))
    pcs = p.where(F.col("p_size") > 45).select(F.col("p_partkey").cast("string").alias("code"),
                                               F.concat(F.lit("pcs "), F.col("p_brand")).alias("description"))
    item_map = s.where(F.col("s_acctbal") >= 2500).select(  # the other lab codes keep their description
        F.concat(F.lit("LOINC/"), F.col("s_suppkey").cast("string")).alias("code"), F.concat(F.lit("item "), "s_name").alias("item_name"))
    ranges = item_map.select("item_name").distinct().select(
        "item_name", F.lit("10").alias("ref_low"), F.lit("40").alias("ref_high"), F.lit("mg").alias("ref_unit"))
    return code_map, cpt4, pcs, item_map, ranges


def merged(spark, sf, *cols, where=None):
    """Rows, all or those ``where`` holds, with the columns ``cols`` beside their place and code, and samples, as merged. What was
    written for them is deleted."""
    before = stages_written()
    prow = rows(spark, sf)
    asked = samples(spark, sf, prow)
    mine = prow if where is None else prow.where(where)
    out = om.merge(mine.select("patient_id", "pos", "omop_table", "code", *cols), asked)
    drop_stages(spark, before, *out)
    return out


cte("o_orows", (), f"""
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY start_us, omop_table, code, value NULLS FIRST, k1, k2) - 1
           AS pos FROM (
    SELECT c_custkey AS patient_id, 'person' AS omop_table, 'SEG/' || c_mktsegment AS code, CAST(NULL AS VARCHAR) AS value,
           CAST(NULL AS VARCHAR) AS unit, {PERSON_START_US} AS start_us, CAST(0 AS BIGINT) AS k1, 0 AS k2 FROM customer
    UNION ALL
    SELECT o_custkey,
           CASE WHEN l_linestatus = 'F' THEN 'measurement' WHEN l_returnflag = 'R' THEN 'condition_occurrence'
                ELSE 'drug_exposure' END,
           CASE WHEN l_linestatus = 'F' THEN 'LOINC/' || CAST(l_suppkey AS VARCHAR)
                WHEN l_returnflag = 'R' THEN 'ICD10CM/' || CAST(l_suppkey AS VARCHAR) ELSE 'RxNorm/' || CAST(l_partkey AS VARCHAR) END,
           CASE WHEN l_linestatus = 'F' AND l_discount <> 0 THEN printf('%.1f', l_quantity) END,
           CASE WHEN l_linestatus = 'F' THEN 'mg' END, epoch_us(l_shipdate), l_orderkey, l_linenumber
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL
    SELECT o_custkey, 'note', 'NOTE', NULL, NULL, epoch_us(o_orderdate), o_orderkey, 0 FROM orders
    WHERE o_orderpriority = '1-URGENT')""")
cte("o_osamples", ("o_orows",), """
  SELECT o_orderkey AS sample_id, o_custkey AS patient_id,
         CASE o_orderstatus WHEN 'F' THEN 'lab_hyperkalemia' WHEN 'O' THEN 'guo_readmission' ELSE 'new_pancan' END AS task_name,
         CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN o_totalprice < 150000 THEN 'normal' ELSE 'abnormal' END)
              ELSE (CASE WHEN o_totalprice < 150000 THEN 'True' ELSE 'False' END) END AS label,
         CAST(0 AS BIGINT) AS period_begin,
         (SELECT count(*) FROM o_orows r WHERE r.patient_id = o.o_custkey AND r.start_us <= epoch_us(o.o_orderdate)) - 1
           AS period_end
  FROM orders o""")
cte("o_oslice", ("o_osamples",), """
  SELECT s.sample_id, r.*, r.pos - 1000000 AS ord FROM o_osamples s JOIN o_orows r
    ON r.patient_id = s.patient_id AND r.omop_table = 'person'
  UNION ALL
  SELECT s.sample_id, r.*, r.pos + 1 FROM o_osamples s JOIN o_orows r
    ON r.patient_id = s.patient_id AND r.pos BETWEEN s.period_begin AND s.period_end""")
cte("o_obooks", (), """
  SELECT DISTINCT 'SEG/' || c_mktsegment AS code, 'segment ' || lower(c_mktsegment) AS description FROM customer
  UNION ALL SELECT 'LOINC/' || CAST(s_suppkey AS VARCHAR), 'lab ' || s_name FROM supplier
  UNION ALL SELECT 'RxNorm/' || CAST(p_partkey AS VARCHAR),
                   CASE WHEN p_size > 40 THEN 'ICD10PCS/' || CAST(p_partkey AS VARCHAR) ELSE lower(p_type) || ' ' || p_name END
            FROM part
  UNION ALL SELECT 'ICD10CM/' || CAST(s_suppkey AS VARCHAR),
                   CASE WHEN s_acctbal < 0 THEN 'CPT4/' || CAST(s_suppkey AS VARCHAR) ELSE 'condition ' || s_name END
            FROM supplier""")
cte("o_ocontent", ("o_oslice", "o_obooks"), """
  SELECT x.*, CASE WHEN contains(b.description, 'CPT4')
                   THEN (SELECT 'procedure ' || s_name FROM supplier WHERE s_nationkey < 10
                         AND CAST(s_suppkey AS VARCHAR) = regexp_replace(b.description, '^[^/]*/', ''))
                   WHEN contains(b.description, 'ICD10PCS')
                   THEN (SELECT 'pcs ' || p_brand FROM part WHERE p_size > 45
                         AND CAST(p_partkey AS VARCHAR) = regexp_replace(b.description, '^[^/]*/', ''))
                   ELSE b.description END AS content, b.description AS raw_desc
  FROM o_oslice x LEFT JOIN o_obooks b USING (code)""")
cte("o_omeas", ("o_ocontent",), """
  SELECT * FROM (
    SELECT sample_id, omop_table, ord, name, value, flag, line,
           row_number() OVER (PARTITION BY sample_id, omop_table, name ORDER BY ord DESC) AS rk FROM (
      SELECT x.*, coalesce(im.item_name, x.raw_desc) AS name,
             CASE WHEN im.item_name IS NOT NULL THEN
               CASE WHEN TRY_CAST(value AS DOUBLE) >= 10 AND TRY_CAST(value AS DOUBLE) <= 40 THEN 'normal' ELSE 'abnormal' END
             END AS flag,
             '| ' || CASE WHEN im.item_name IS NOT NULL
                 THEN im.item_name || ' | ' || value || ' | mg | 10 | 40 | ' ||
                      CASE WHEN TRY_CAST(value AS DOUBLE) >= 10 AND TRY_CAST(value AS DOUBLE) <= 40 THEN 'normal' ELSE 'abnormal' END
                 ELSE x.raw_desc || ' | ' || value || ' | ' || coalesce(unit, 'None') || ' | nan | nan | nan' END || ' |' AS line,
             im.item_name IS NOT NULL AS mapped
      FROM o_ocontent x LEFT JOIN (SELECT 'LOINC/' || CAST(s_suppkey AS VARCHAR) AS code, 'item ' || s_name AS item_name FROM supplier
                                   WHERE s_acctbal >= 2500) im USING (code)
      WHERE omop_table NOT IN ('person', 'note') AND NOT regexp_matches(lower(omop_table), 'drug|condition|procedure'))
    WHERE name IS NOT NULL AND value IS NOT NULL AND (NOT mapped OR TRY_CAST(value AS DOUBLE) IS NOT NULL))
  WHERE rk = 1""")
cte("o_ovisit", ("o_ocontent",), """
  SELECT sample_id, omop_table, '- ' || content AS line, min(ord) AS ord FROM o_ocontent
  WHERE regexp_matches(lower(omop_table), 'drug|condition|procedure') AND content IS NOT NULL
  GROUP BY sample_id, omop_table, '- ' || content""")
cte("o_octx", ("o_omeas", "o_ovisit"), """
  SELECT sample_id, string_agg(gtext, chr(10) || chr(10) ORDER BY g_start, omop_table) AS input FROM (
    SELECT g.sample_id, g.omop_table, g.g_start,
           CASE WHEN g.omop_table NOT IN ('person') AND NOT regexp_matches(lower(g.omop_table), 'drug|condition|procedure')
                THEN CASE WHEN l.body IS NOT NULL THEN title || chr(10) ||
                     '| Item_Name | Valuenum | Valueuom | Ref_Range_Lower | Ref_Range_Upper | Flag |' || chr(10) ||
                     '| ------ | ------ | ------ | ------ | ------ | ------ |' || chr(10) || l.body END
                ELSE CASE WHEN l.body IS NOT NULL THEN title || chr(10) || l.body ELSE title END END AS gtext
    FROM (SELECT sample_id, omop_table, first(start_us ORDER BY ord) AS g_start,
                 '## ' || CASE omop_table WHEN 'person' THEN 'Person' WHEN 'measurement' THEN 'Measurement'
                   WHEN 'drug_exposure' THEN 'Drug_Exposure' WHEN 'condition_occurrence' THEN 'Condition_Occurrence'
                   ELSE omop_table END || ' [' || strftime(make_timestamp(first(start_us ORDER BY ord)), '%Y-%m-%d %H:%M:%S')
                 || ']' AS title
          FROM o_oslice GROUP BY sample_id, omop_table) g
    LEFT JOIN (SELECT sample_id, omop_table, string_agg(line, chr(10) ORDER BY ord) AS body FROM (
                 SELECT sample_id, omop_table, ord, '- ' || coalesce(content, 'None') AS line FROM o_ocontent
                 WHERE omop_table = 'person'
                 UNION ALL SELECT sample_id, omop_table, ord, line FROM o_ovisit
                 UNION ALL SELECT sample_id, omop_table, ord, line FROM o_omeas) GROUP BY sample_id, omop_table) l
      USING (sample_id, omop_table)
    WHERE g.omop_table <> 'note')
  WHERE gtext IS NOT NULL GROUP BY sample_id""")


@query("e_omop_slice", ctes("o_oslice") + """
SELECT sample_id, count(*) AS n_rows, count(*) FILTER (WHERE omop_table = 'person') AS n_person FROM o_oslice
GROUP BY sample_id""")
def e_omop_slice(spark, sf):
    prow = rows(spark, sf)
    sl = om.slice_rows(prow.select("patient_id", "pos", "omop_table"), samples(spark, sf, prow))
    return sl.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count(F.when(F.col("omop_table") == "person", 1)).alias("n_person"))


@query("e_omop_code", ctes("o_ovisit") + """
SELECT sample_id, omop_table, string_agg(line, chr(10) ORDER BY ord) AS lines FROM o_ovisit GROUP BY ALL""")
def e_omop_code(spark, sf):
    code_map, cpt4, pcs, _, _ = books(spark, sf)
    v = om.visit_lines(*merged(spark, sf, where=om.is_visit()), code_map, cpt4, pcs)
    return v.groupBy("sample_id", "omop_table").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))


@query("e_omop_latest", ctes("o_omeas") + "SELECT sample_id, omop_table, name, value FROM o_omeas")
def e_omop_latest(spark, sf):
    code_map, _, _, item_map, ranges = books(spark, sf)
    rows_ = merged(spark, sf, "value", where=om.is_measurement())
    return om.measurements(*rows_, code_map, item_map, ranges, ("value",)).select("sample_id", "omop_table", "name", "value")


@query("e_omop_flag", ctes("o_omeas") + "SELECT sample_id, name, flag FROM o_omeas WHERE flag IS NOT NULL")
def e_omop_flag(spark, sf):
    code_map, _, _, item_map, ranges = books(spark, sf)
    m = om.measurements(*merged(spark, sf, "value", where=om.is_measurement()), code_map, item_map, ranges, ("flag",))
    return m.where(F.col("flag").isNotNull()).select("sample_id", "name", "flag")


@query("e_omop_context", ctes("o_octx") + "SELECT sample_id, md5(input) AS input_md5, length(input) AS input_len FROM o_octx")
def e_omop_context(spark, sf):
    ctx = om.omop_context(*merged(spark, sf, "value", "unit", "start_us", where=F.col("omop_table") != "note"), *books(spark, sf))
    return ctx.select("sample_id", F.md5("input").alias("input_md5"), F.length("input").cast("bigint").alias("input_len"))


@query("e_omop_label", ctes("o_osamples") + """
SELECT sample_id, task_name, CASE WHEN contains(task_name, 'lab_') THEN (CASE WHEN label = 'normal' THEN 'yes' ELSE 'no' END)
                                  ELSE label END AS output FROM o_osamples""")
def e_omop_label(spark, sf):
    prow = rows(spark, sf)
    return om.omop_label(samples(spark, sf, prow)).select("sample_id", "task_name", "output")
