"""Case-table queries (E15, E16): every order is a case.

history = customer name and segment, exam = account balance, lab tests = its
lineitems (itemid = part key; 'quantity mg' for status F, a bare number
otherwise), reference ranges 10..40 for status F items, microbiology = returned
lines (supplier key -> 'positive'), radiology = one entry per line, diagnoses =
the sorted distinct part names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cases as cs
from tidemark.plans.oracle import cte, ctes
from tidemark.plans.registry import query
from tidemark.sources.tables import table


def cases(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    li = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    # a repeated key keeps its last entry (dict semantics): last line number wins,
    # found by a partial aggregation per (order, part)
    last = (li.groupBy("l_orderkey", "l_partkey")
            .agg(F.max(F.struct("l_linenumber", "l_quantity", "l_linestatus")).alias("_k"))
            .select(F.col("l_orderkey").alias("_lo"), F.col("l_partkey").alias("_lp"),
                    F.col("_k.l_linenumber").alias("_ln"), F.col("_k.l_quantity").alias("_lq"),
                    F.col("_k.l_linestatus").alias("_ls"), F.lit(True).alias("_last_part")))
    cond = ((F.col("l_orderkey") == F.col("_lo")) & (F.col("l_partkey") == F.col("_lp"))
            & (F.col("l_linenumber") == F.col("_ln")) & (F.col("l_quantity") == F.col("_lq"))
            & (F.col("l_linestatus") == F.col("_ls")))
    li = (li.join(last, cond, "left").drop("_lo", "_lp", "_ln", "_lq", "_ls")
          .withColumn("_last_part", F.coalesce("_last_part", F.lit(False))))
    f = F.col("l_linestatus") == "F"
    lab_val = F.when(f, F.format_string("%.1f mg", F.col("l_quantity"))).otherwise(F.format_string("%.1f", F.col("l_quantity")))
    per = li.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_last_part"), F.struct(F.col("l_partkey").cast("string"), lab_val))))
        .alias("lab_tests"),
        F.map_from_entries(F.collect_list(F.when(f & F.col("_last_part"), F.struct(F.col("l_partkey").cast("string"),
                                                                                   F.lit("10"))))).alias("range_lower"),
        F.map_from_entries(F.collect_list(F.when(f & F.col("_last_part"), F.struct(F.col("l_partkey").cast("string"),
                                                                                   F.lit("40"))))).alias("range_upper"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(
            F.col("l_suppkey").cast("string"), F.lit("positive")))))).alias("microbiology"),
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.concat(
            F.lit("exam "), F.col("l_linenumber").cast("string")).alias("exam_name"), F.concat(
            F.lit(" shipped "), F.col("l_shipdate").cast("date").cast("string"), F.lit(" ")).alias("report")))).alias("radiology"),
        F.array_sort(F.collect_set("p_name")).alias("diagnoses"))
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(per, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_orderkey").alias("case_id"), F.lower(F.split("o_orderpriority", "-")[1]).alias("category"),
                    F.concat_ws(" ", "c_name", "c_mktsegment").alias("history"),
                    F.format_string("balance %.2f", F.col("c_acctbal")).alias("exam"),
                    "lab_tests", "range_lower", "range_upper", "microbiology", "radiology", "diagnoses"))


def names(spark, sf):
    lab = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("itemid"), F.col("p_name").alias("label"))
    mic = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("itemid"),
                                              F.concat(F.lit("culture "), F.col("s_name")).alias("label"))
    return lab, mic


cte("o_clabs", (), """
  SELECT DISTINCT ON (l.l_orderkey, l.l_partkey) l.l_orderkey AS case_id, CAST(l.l_partkey AS VARCHAR) AS itemid,
         CASE WHEN l.l_linestatus = 'F' THEN printf('%.1f', l.l_quantity) ELSE printf('%.1f', l.l_quantity) END AS result,
         CASE WHEN l.l_linestatus = 'F' THEN 'mg' END AS unit,
         CASE WHEN l.l_linestatus = 'F' THEN '10' END AS ref_low, CASE WHEN l.l_linestatus = 'F' THEN '40' END AS ref_high,
         p.p_name AS label
  FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey
  ORDER BY l.l_orderkey, l.l_partkey, l.l_linenumber DESC, l.l_quantity DESC, l.l_linestatus DESC""")


@query("e_case_labs", ctes("o_clabs") + "SELECT * FROM o_clabs")
def e_case_labs(spark, sf):
    lab, _ = names(spark, sf)
    return cs.case_labs(cases(spark, sf), lab).select("case_id", "itemid", "result", "unit", "ref_low", "ref_high", "label")


_LAB_H = "'| ' || 'Item_name | Valuenum | Valueuom | Ref_range_lower | Ref_range_upper' || ' |' || chr(10) || '| ------ | ------ | ------ | ------ | ------ |'"
_MIC_H = "'| Item_name | Valuestr |' || chr(10) || '| ------ | ------ |'"
_RAD_H = "'| Exam_name | Text |' || chr(10) || '| ------ | ------ |'"


@query("e_case_text", ctes("o_clabs") + f"""
SELECT o_orderkey AS case_id, lower(split_part(o_orderpriority, '-', 2)) || '_diagnosis' AS task,
  md5(concat_ws(chr(10), '## Patient Demographics', '- Patient History: ' || c_name || ' ' || c_mktsegment,
      '- Physical Examination: ' || printf('balance %.2f', c_acctbal), chr(10), '## Labotary Test Events', {_LAB_H},
      lab.lines,
      CASE WHEN mic.lines IS NOT NULL THEN concat_ws(chr(10), chr(10), '## Microbiology Test Events', {_MIC_H}, mic.lines) END,
      chr(10), '## Radiology Examinations', {_RAD_H}, rad.lines)) AS input_md5,
  dx.dx AS output
FROM orders JOIN customer ON c_custkey = o_custkey
JOIN (SELECT case_id, string_agg('| ' || coalesce(label, 'None') || ' | ' || result || ' | ' || coalesce(unit, 'None') || ' | '
                                 || coalesce(ref_low, 'None') || ' | ' || coalesce(ref_high, 'None') || ' |', chr(10) ORDER BY itemid)
             AS lines FROM o_clabs GROUP BY case_id) lab
  ON lab.case_id = o_orderkey
LEFT JOIN (SELECT l_orderkey, string_agg('| culture ' || s_name || ' | positive |', chr(10) ORDER BY CAST(l_suppkey AS VARCHAR))
                  AS lines
           FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') JOIN supplier ON s_suppkey = l_suppkey
           GROUP BY l_orderkey) mic ON mic.l_orderkey = o_orderkey
JOIN (SELECT l_orderkey, string_agg('| exam ' || CAST(l_linenumber AS VARCHAR) || ' | shipped ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ' |',
                                    chr(10) ORDER BY l_linenumber, CAST(l_shipdate AS DATE)) AS lines
      FROM lineitem GROUP BY l_orderkey) rad ON rad.l_orderkey = o_orderkey
JOIN (SELECT l_orderkey, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS dx FROM lineitem JOIN part ON p_partkey = l_partkey
      GROUP BY l_orderkey) dx ON dx.l_orderkey = o_orderkey""")
def e_case_text(spark, sf):
    lab, mic = names(spark, sf)
    cz = cases(spark, sf)
    t = cs.case_text(cz, cs.case_labs(cz, lab), mic)
    return t.select("case_id", "task", F.md5("input").alias("input_md5"), F.array_join("output", "|").alias("output"))
