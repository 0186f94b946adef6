"""Case rows with map/array columns -> lab rows and one case text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LAB_KEYS = ["Item_name", "Valuenum", "Valueuom", "Ref_range_lower", "Ref_range_upper"]
MICRO_KEYS = ["Item_name", "Valuestr"]
RAD_KEYS = ["Exam_name", "Text"]


def _header(keys):
    return "| " + " | ".join(keys) + " |\n| " + " | ".join(["------"] * len(keys)) + " |"


def case_labs(cases: DataFrame, lab_names: DataFrame, key: str = "case_id") -> DataFrame:
    """One row per lab map entry: item name from the dictionary, 'value unit'
    split when exactly two tokens (else unit NULL), reference range by item."""
    e = cases.select(key, F.explode("lab_tests").alias("itemid", "raw"), "range_lower", "range_upper")
    toks = F.split("raw", " ")
    two = F.size(toks) == 2
    e = e.select(key, "itemid", F.when(two, F.try_element_at(toks, F.lit(1))).otherwise(F.col("raw")).alias("result"),
                 F.when(two, F.try_element_at(toks, F.lit(2))).alias("unit"),
                 F.try_element_at("range_lower", F.col("itemid")).alias("ref_low"),
                 F.try_element_at("range_upper", F.col("itemid")).alias("ref_high"))
    return e.join(lab_names.select("itemid", "label"), "itemid", "left")


def case_text(cases: DataFrame, labs: DataFrame, micro_names: DataFrame, key: str = "case_id") -> DataFrame:
    """Demographics, lab table, microbiology (when present), radiology -> text;
    output = the diagnosis list. Map entries are rendered in key order."""
    def cell(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lab_rows = (labs.select(key, "itemid", F.concat(F.lit("| "), F.concat_ws(" | ", cell("label"), cell("result"),
                                                                              cell("unit"), cell("ref_low"), cell("ref_high")),
                                                     F.lit(" |")).alias("line"))
                .groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("itemid", "line"))),
                                                           lambda x: x["line"]), "\n").alias("lab_lines")))
    mic = (cases.select(key, F.explode("microbiology").alias("itemid", "res"))
           .join(micro_names.select("itemid", F.col("label").alias("mname")), "itemid", "left")
           .select(key, "itemid", F.concat(F.lit("| "), cell("mname"), F.lit(" | "), cell("res"), F.lit(" |")).alias("line"))
           .groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("itemid", "line"))),
                                                      lambda x: x["line"]), "\n").alias("micro_lines")))
    rad = F.array_join(F.transform("radiology", lambda r: F.concat(F.lit("| "), r["exam_name"], F.lit(" | "),
                                                                   F.trim(r["report"]), F.lit(" |"))), "\n")
    c = cases.join(lab_rows, key, "left").join(mic, key, "left")
    parts = [F.lit("## Patient Demographics"), F.concat(F.lit("- Patient History: "), F.col("history")),
             F.concat(F.lit("- Physical Examination: "), F.col("exam")), F.lit("\n"), F.lit("## Labotary Test Events"),
             F.lit(_header(LAB_KEYS)), F.col("lab_lines"),
             F.when(F.col("micro_lines").isNotNull(),
                    F.concat_ws("\n", F.lit("\n"), F.lit("## Microbiology Test Events"), F.lit(_header(MICRO_KEYS)),
                                F.col("micro_lines"))),
             F.lit("\n"), F.lit("## Radiology Examinations"), F.lit(_header(RAD_KEYS)),
             F.when(F.size("radiology") > 0, rad)]
    return c.select(key, F.concat(F.col("category"), F.lit("_diagnosis")).alias("task"),
                    F.concat_ws("\n", *parts).alias("input"), F.col("diagnoses").alias("output"))
