"""OMOP-style patient rows -> per-sample context text.

Rows carry (patient_id, pos, omop_table, code, value, unit, start_us), ``pos`` dense from 0. A sample
is (sample_id, patient_id, period_begin, period_end) with an inclusive end.

No sample is expanded to the rows of its period. Samples are merged into their patient's row
order (:func:`merge`): a row then knows how many samples end before it, a sample its place
among them, and the state "latest row of this item" is a range of samples' places, from the
row to the next one of its item. These ranges meet buckets of samples (``operators.intervals``), so what is
shuffled grows with rows and result, not with samples x rows, and a busy patient is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators.ordering import run_heads, running_sums
from tidemark.operators.render import fmt_us

# Table names whose display title is computed on the driver (Python title-casing).
OMOP_TABLES = ("person", "measurement", "observation", "drug_exposure", "condition_occurrence",
               "procedure_occurrence", "visit_occurrence", "device_exposure", "note")


SLICE_ROWS = 250_000  # of a task of slice_rows
PERIOD = ["sample_id", "patient_id", "period_begin", "period_end"]
_VISIT = "drug|condition|procedure"


def slice_rows(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Person rows, then rows period_begin..period_end (inclusive); a person
    row inside the slice appears twice, as in the reference. ``ord`` keeps that order.

    The result itself has samples x rows; the texts of E11-E13 are made without it. Of the columns those go along that
    ``rows`` has: nothing prunes them inside the buckets, so a caller leaves out what it doesn't read."""
    s = samples.select(*PERIOD)
    cols = [c for c in ("omop_table", "code", "value", "unit", "start_us") if c in rows.columns]
    # a task holds its rows and ranges sorted: with more rows there are more tasks, and adaptive execution leaves them as they are
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    found = iv.events_in(s, iv.bucketed(rows, cols, "patient_id", "pos", partitions=n), F.col("period_begin"), F.col("period_end") + 1, "patient_id")
    body = (found.select("sample_id", "patient_id", F.explode("found").alias("r"))
            .select("sample_id", "patient_id", F.col("r.i").alias("pos"), (F.col("r.i") + 1).alias("ord"), *(F.col(f"r.{c}") for c in cols)))
    person = s.join(rows.where(F.col("omop_table") == "person"), "patient_id").withColumn("ord", -1000000 + F.col("pos"))
    return person.select(*body.columns).unionByName(body)


_COUNTS = ["ended", "begun", "n_samples"]  # what merge adds to a row


def merge(rows: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``ended`` and ``begun``, how many of their patient's samples end before them and how many of the begins of periods
    lie at or before them, and ``n_samples``; samples with ``place``, their 0-based place by end. All come from one order of rows
    and samples; written once. ``rows`` can be a part of the patient's rows: ``pos`` need not be dense."""
    s = samples.select(*PERIOD)
    own = rows.withColumns({"_at": F.col("pos").cast("bigint"), "_kind": F.lit(0)})
    ends = s.select("patient_id", F.greatest("period_end", F.lit(-1)).cast("bigint").alias("_at"), F.lit(1).alias("_kind"),
                    *(F.col(c).alias(f"_{c}") for c in PERIOD if c != "patient_id"))
    begins = s.select("patient_id", F.col("period_begin").cast("bigint").alias("_at")).dropna(subset="_at").distinct().withColumn("_kind", F.lit(-1))
    heads = s.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(-2))  # without a place: ahead of all
    both = own
    for more in (ends, begins, heads):
        both = both.unionByName(more, allowMissingColumns=True)
    kind = F.col("_kind")
    both = running_sums(both, ["patient_id"], [F.col("_at"), kind, F.col("_sample_id")],
                        {"ended": kind == 1, "begun": kind == -1, "n_samples": F.when(kind == -2, F.col("_n"))}, kind >= 0)
    return (both.where("_kind = 0").select(*rows.columns, *_COUNTS),
            both.where("_kind = 1").select(*(F.col(c if c == "patient_id" else f"_{c}").alias(c) for c in PERIOD), (F.col("ended") - 1).alias("place")))


def _latest_held(rows: DataFrame, item: list[str]) -> DataFrame:
    """(patient_id, ...row, ended, until, prev): of each item the rows that are its latest for the samples with a place in
    [ended, until).

    Rows that no sample ends behind before the next of their item never become state: only the last of each
    (item, number of ended samples) is carried on."""
    held = run_heads(rows.where("ended < n_samples"), ["patient_id", *item], "ended", [F.desc("ended"), F.desc("pos")], "ended")
    return held.withColumns({"until": F.least("ahead", "n_samples"), "prev": F.lit(None).cast("bigint")}).drop("ahead", "begun", "n_samples")


def _earliest_held(rows: DataFrame, item: list[str]) -> DataFrame:
    """(patient_id, ...row, ended, until, prev): of each item the rows that are its first for those samples with a place in
    [ended, until) whose period begins behind ``prev``.

    Of the rows between two begins of periods only the first can be one, and none ahead of all begins or behind all ends."""
    held = run_heads(rows.where("ended < n_samples and begun > 0"), ["patient_id", *item], "begun", [F.col("begun"), F.col("pos")], "pos")
    return held.withColumns({"until": F.col("n_samples"), "prev": F.col("ahead")}).drop("ahead", "begun", "n_samples")


def _in_period(pos: Column, prev: Column, begin: Column) -> Column:
    return (pos >= begin) & (prev.isNull() | (prev < begin))


def _sample_buckets(samples: DataFrame, *more: str) -> DataFrame:
    return iv.bucketed(samples, ["sample_id", "period_begin", *more], "patient_id", "place")


def _matched(held: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, ...row) for the samples whose state the rows are."""
    found = iv.events_in(held, _sample_buckets(samples), F.col("ended"), F.col("until"), "patient_id").withColumn("s", F.explode("found"))
    found = found.where(_in_period(F.col("pos"), F.col("prev"), F.col("s.period_begin")))
    return found.select(F.col("s.sample_id").alias("sample_id"), *(c for c in held.columns if c not in ("ended", "until", "prev")))


def latest(rows: DataFrame, samples: DataFrame, item: list[str]) -> DataFrame:
    """(sample_id, ...row): of each item the last row in each sample's period. ``rows`` and ``samples`` as merged."""
    return _matched(_latest_held(rows, item), samples)


def earliest(rows: DataFrame, samples: DataFrame, item: list[str]) -> DataFrame:
    """(sample_id, ...row): of each item the first row in each sample's period. ``rows`` and ``samples`` as merged."""
    return _matched(_earliest_held(rows, item), samples)


def resolve_codes(rows: DataFrame, code_map: DataFrame, cpt4: DataFrame, icd10pcs: DataFrame) -> DataFrame:
    """Code -> description; a description naming a CPT4 or ICD10PCS code
    is resolved in that book; unresolved -> NULL (dropped by the renderers)."""
    # all of it is known from the book: the rows take part in one join, by their code
    ref = F.regexp_replace("description", "^[^/]*/", "")  # all after the first slash
    is_cpt4, is_pcs = F.col("description").contains("CPT4"), F.col("description").contains("ICD10PCS")
    book = (code_map.select("code", "description")
            .join(cpt4.select(F.col("code").alias("_c4"), F.col("description").alias("_d4")), is_cpt4 & (F.col("_c4") == ref), "left")
            .join(icd10pcs.select(F.col("code").alias("_cp"), F.col("description").alias("_dp")), ~is_cpt4 & is_pcs & (F.col("_cp") == ref), "left"))
    content = F.when(is_cpt4, F.col("_d4")).when(is_pcs, F.col("_dp")).otherwise(F.col("description"))
    return rows.join(book.select("code", "description", content.alias("content")), "code", "left")


def is_visit() -> Column:
    """Rows of E12: drugs, conditions and procedures."""
    return F.lower("omop_table").rlike(_VISIT)


def is_measurement() -> Column:
    """Rows of E11."""
    return ~F.col("omop_table").isin("person", "note") & ~is_visit()


def _measured(rows: DataFrame, code_map: DataFrame, item_map: DataFrame, ranges: DataFrame, shown: tuple[str, ...]) -> DataFrame:
    m = rows.where(is_measurement()).where("ended < n_samples")
    # ranges meet the items in the book: rows without an item have no name, and would all go to one task
    items = item_map.select("code", "item_name").join(ranges, "item_name", "left")
    m = m.join(items, "code", "left").join(code_map.select("code", F.col("description").alias("_desc")), "code", "left")
    name = F.coalesce(F.col("item_name"), F.col("_desc"))
    num = F.col("value").try_cast("double")
    mapped = F.col("item_name").isNotNull()
    ok = name.isNotNull() & F.col("value").isNotNull() & (~mapped | num.isNotNull())
    flag = F.when((num >= F.col("ref_low").cast("double")) & (num <= F.col("ref_high").cast("double")), F.lit("normal")) \
        .otherwise(F.lit("abnormal"))
    row = F.when(mapped, F.concat_ws(" | ", name, F.col("value"), F.col("ref_unit"), F.col("ref_low"), F.col("ref_high"), flag)) \
        .otherwise(F.concat_ws(" | ", name, F.col("value"), F.coalesce(F.col("unit"), F.lit("None")),
                               F.lit("nan"), F.lit("nan"), F.lit("nan"))) if "line" in shown else None
    values = {"value": F.col("value"), "flag": F.when(mapped, flag)} | ({"line": F.concat(F.lit("| "), row, F.lit(" |"))} if "line" in shown else {})
    return m.where(ok).select("patient_id", "omop_table", "pos", name.alias("name"), *_COUNTS, *(values[c].alias(c) for c in shown))


def measurements(rows: DataFrame, samples: DataFrame, code_map: DataFrame, item_map: DataFrame, ranges: DataFrame,
                 shown: tuple[str, ...] = ("value", "flag", "line")) -> DataFrame:
    """Measurement lines per sample. Name from the item map (with reference range and a
    normal/abnormal flag) else from the code book (range 'nan'); non-numeric or
    missing values skipped; only the latest row per item kept. ``rows`` and ``samples`` as merged. ``shown``: which
    of value, flag and line are wanted; what is not is neither made nor written."""
    kept = _measured(rows, code_map, item_map, ranges, shown)
    return latest(kept, samples, ["omop_table", "name"]).withColumn("ord", F.col("pos") + 1).drop("pos", "patient_id")


def _visited(rows: DataFrame, code_map: DataFrame, cpt4: DataFrame, icd10pcs: DataFrame) -> DataFrame:
    res = resolve_codes(rows.where(is_visit()).where("ended < n_samples and begun > 0"), code_map, cpt4, icd10pcs).where(F.col("content").isNotNull())
    return res.select("patient_id", "omop_table", F.concat(F.lit("- "), "content").alias("line"), "pos", *_COUNTS)


def visit_lines(rows: DataFrame, samples: DataFrame, code_map: DataFrame, cpt4: DataFrame, icd10pcs: DataFrame) -> DataFrame:
    """(sample_id, omop_table, line, ord): the distinct resolved drugs, conditions and procedures of each period, at their
    first row. ``rows`` and ``samples`` as merged."""
    lines = _visited(rows, code_map, cpt4, icd10pcs)
    return earliest(lines, samples, ["omop_table", "line"]).select("sample_id", "omop_table", "line", (F.col("pos") + 1).alias("ord"))


MEASURE_HEADER = ("| Item_Name | Valuenum | Valueuom | Ref_Range_Lower | Ref_Range_Upper | Flag |\n"
                  "| ------ | ------ | ------ | ------ | ------ | ------ |")


#: What a sample's text can be made of, by part: its groups, their lines, a person's lines.
_PARTS = {"groups": ["omop_table", "pos", "start_us", "prev", "ended", "until"], "lines": ["omop_table", "pos", "line", "prev", "ended", "until"],
          "persons": ["omop_table", "pos", "line", "start_us"]}
_TYPES = {"omop_table": "string", "line": "string"}
_NO_PART = {part: f"struct<{', '.join(f'{c}: {_TYPES.get(c, "bigint")}' for c in cols)}>" for part, cols in _PARTS.items()}


def _candidates(held: DataFrame, part: str) -> DataFrame:
    """(patient_id, ended, until, part, ...row)"""
    return held.select("patient_id", "ended", "until", *(F.struct(*(F.col(x).cast(_TYPES.get(x, "bigint")).alias(x) for x in cols)).alias(c) if c == part else F.lit(None).cast(_NO_PART[c]).alias(c) for c, cols in _PARTS.items()))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable), however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _context_parts(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, groups, lines, persons) for each sample: the candidates meet buckets of samples, and a bucket's samples choose
    among them in place, so that no line is shuffled for each of its samples."""
    cut = candidates.where("until > ended").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ended") / iv.WIDTH), F.floor((F.col("until") - 1) / iv.WIDTH))))
    held = cut.groupBy("patient_id", "bucket").agg(*(F.collect_list(c).alias(c) for c in _PARTS))
    asked = held.join(_sample_buckets(samples, "period_end"), ["patient_id", "bucket"])

    def line(c, at):
        return F.struct(c["omop_table"].alias("omop_table"), at.cast("bigint").alias("ord"), c["line"].alias("line"))

    def chosen(part, s):
        return F.filter(part, lambda c: (c["ended"] <= s["i"]) & (s["i"] < c["until"]) & _in_period(c["pos"], c["prev"], s["period_begin"]))

    def parts(s):
        again = F.filter("persons", lambda c: c["pos"].between(s["period_begin"], s["period_end"]))
        return F.struct(
            s["sample_id"].alias("sample_id"),
            F.transform(chosen("groups", s), lambda c: F.struct(c["start_us"].alias("g_start"), c["omop_table"].alias("omop_table"))).alias("groups"),
            F.concat(F.transform(chosen("lines", s), lambda c: line(c, c["pos"] + 1)), F.transform("persons", lambda c: line(c, c["pos"] - 1000000)),
                     F.transform(again, lambda c: line(c, c["pos"] + 1))).alias("lines"),
            F.transform("persons", lambda c: F.struct(c["pos"].alias("pos"), c["start_us"].alias("start_us"))).alias("persons"))
    return asked.select(F.explode(F.transform("found", parts)).alias("p")).select("p.*")


def omop_context(rows: DataFrame, samples: DataFrame, code_map: DataFrame, cpt4: DataFrame, icd10pcs: DataFrame,
                 item_map: DataFrame, ranges: DataFrame) -> DataFrame:
    """One text per sample: groups by table ordered by their first row's start
    (then table name); notes skipped; measurement groups without a kept row skipped. ``rows`` and ``samples`` as merged.

    A patient's person rows come first, and once more where the period holds them."""
    live = rows.where("ended < n_samples")
    person = resolve_codes(rows.where("omop_table = 'person' and n_samples > 0").select("patient_id", "omop_table", "pos", "code", "start_us", "n_samples"),
                           code_map, cpt4, icd10pcs)
    person = person.withColumns({"line": F.concat(F.lit("- "), F.coalesce("content", F.lit("None"))), "ended": F.lit(0).cast("bigint"), "until": F.col("n_samples")})
    # rows of a table between the same begins: only the first can be the first of a period, and few are left to be ordered
    first = F.min_by(F.struct("pos", "start_us", "ended", "n_samples"), "pos")
    firsts = (live.where("begun > 0").where(~F.col("omop_table").isin("person", "note")).groupBy("patient_id", "omop_table", "begun")
              .agg(first.alias("_r")).select("patient_id", "omop_table", "begun", "_r.*"))
    found = [_candidates(_earliest_held(firsts, ["omop_table"]), "groups"),
             _candidates(_earliest_held(_visited(rows, code_map, cpt4, icd10pcs), ["omop_table", "line"]), "lines"),
             _candidates(_latest_held(_measured(rows, code_map, item_map, ranges, ("line",)), ["omop_table", "name"]), "lines"),
             _candidates(person, "persons")]
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    # samples that share an id share a text; all others are whole as they are
    repeats = F.count(F.lit(1)).over(Window.partitionBy("sample_id"))
    asked = samples.withColumn("_same", repeats)
    arrays = ["groups", "lines", "persons"]
    whole = _context_parts(candidates, asked.where("_same = 1")).select("sample_id", *arrays).unionByName(
        _context_parts(candidates, asked.where("_same > 1")).groupBy("sample_id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in arrays)))
    own = F.when(F.size("persons") > 0, F.array(F.struct(F.array_min("persons")["start_us"].alias("g_start"), F.lit("person").alias("omop_table"))))
    shown = F.create_map(*[F.lit(x) for t in OMOP_TABLES for x in (t, t.title())])

    def is_meas(g):
        return (g["omop_table"] != "person") & ~F.lower(g["omop_table"]).rlike(_VISIT)

    def text(g):
        name = F.coalesce(F.try_element_at(shown, g["omop_table"]), F.initcap(g["omop_table"]))
        title = F.concat(F.lit("## "), name, F.lit(" ["), fmt_us(g["g_start"]), F.lit("]"))
        mine = F.sort_array(F.transform(F.filter("lines", lambda x: x["omop_table"] == g["omop_table"]), lambda x: F.struct(x["ord"], x["line"].alias("line"))))
        made = _let(mine, lambda xs: F.when(F.size(xs) > 0, F.concat_ws("\n", title, F.when(is_meas(g), F.lit(MEASURE_HEADER)), F.array_join(F.transform(xs, lambda x: x["line"]), "\n")))
                    .when(~is_meas(g), F.concat_ws("\n", title)))
        return F.struct(g["g_start"].alias("g_start"), g["omop_table"].alias("omop_table"), made.alias("gtext"))
    groups = F.filter(F.transform(F.concat("groups", F.coalesce(own, F.slice("groups", 1, 0))), text), lambda x: x["gtext"].isNotNull())
    # every line has its group
    some = whole.where((F.size("lines") > 0) | F.exists("groups", lambda g: ~is_meas(g)))
    return some.select("sample_id", F.array_join(F.transform(F.sort_array(groups), lambda x: x["gtext"]), "\n\n").alias("input"))


def omop_label(samples: DataFrame) -> DataFrame:
    """lab_* tasks: 'normal' -> yes, anything else -> no; other labels pass."""
    lab = F.col("task_name").contains("lab_")
    return samples.withColumn("output", F.when(lab, F.when(F.col("label") == "normal", F.lit("yes")).otherwise(F.lit("no")))
                              .otherwise(F.col("label")))
