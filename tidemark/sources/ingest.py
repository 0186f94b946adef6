"""A family sources: scans, unification, trajectory files, configs, resume/shard."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import MISSING_TEXTS
from tidemark.sources.sinks import subject_bucket

ITEMS_TYPE = "array<map<string,string>>"


def scan_events(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None,
                fmt: str = "csv") -> DataFrame:
    """A1: scan one event table (explicit schema, no inference) and tag its kind.
    Texts that mean 'missing' become NULL at ingest."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    cleaned = [F.when(F.col(c).isin(*MISSING_TEXTS), None).otherwise(F.col(c)).alias(c)
               if isinstance(df.schema[c].dataType, T.StringType) else F.col(c) for c in df.columns]
    return df.select(*cleaned).withColumn("file_name", F.lit(kind))


def select_event_tables(tables: dict[str, DataFrame], exclude: tuple[str, ...] = (),
                        subject: str = "subject_id") -> dict[str, DataFrame]:
    """A2: keep event tables only: drop listed dimension/detail tables and tables
    without a subject column (schema metadata only, no scan)."""
    return {k: v for k, v in tables.items() if k not in exclude and subject in v.columns}


def unify_sources(sources: dict[str, DataFrame], source_rank: dict[str, int]) -> DataFrame:
    """A3: union all sources by name (missing columns NULL), tagged with a rank;
    a missing source is simply absent from the dict."""
    tagged = [df.withColumn("source_rank", F.lit(source_rank[name])) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_subjects(spark: SparkSession, path: str, subjects: DataFrame | None = None, subject: str = "subject_id") -> DataFrame:
    """A table written by ``sinks.write_by_patient``, of all or of the listed subjects.

    The listed subjects' buckets (a number each, as many as there are directories at most) become a partition filter,
    so other directories are not opened; the subjects themselves are a semi join on what is left."""
    df = spark.read.parquet(path)
    if subjects is not None:
        first = df.select("buckets").first()
        n = first["buckets"] if first else 1
        wanted = subjects.select(F.col(subject).cast(df.schema[subject].dataType).alias(subject)).distinct()
        numbers = [r[0] for r in wanted.where(F.col(subject).isNotNull()).select(subject_bucket(subject, n)).distinct().collect()]
        df = df.where(F.col("bucket").isin(numbers)).join(wanted, subject, "left_semi")
    return df.drop("buckets", "bucket")


def read_trajectory(spark: SparkSession, path: str, subjects: DataFrame | None = None) -> DataFrame:
    """Event table written by ``write_trajectory``; ``items`` parsed from JSON."""
    return read_subjects(spark, path, subjects).withColumn("items", F.from_json("items", ITEMS_TYPE))


#: Nested columns of the case table and their types; ranges are numbers.
CASE_COLUMNS = {"lab_tests": "map<string,string>", "range_lower": "map<string,string>", "range_upper": "map<string,string>",
                "microbiology": "map<string,string>", "radiology": "array<struct<exam_name:string,report:string>>", "diagnoses": "array<string>"}
RANGES = ("range_lower", "range_upper")
CASE_FIELDS = ("case_id", "category", "history", "exam")
_JSON = {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _last_wins(entries: Column) -> Column:
    """A map with each key once: of repeated keys in a text the last stays."""
    keys = F.array_distinct(F.map_keys(entries))
    last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(F.map_entries(entries), lambda e: e["key"] == k), -1)["value"]))
    return F.when(F.size(keys) == F.size(entries), entries).otherwise(last)


def _computed_once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, none of which is computed again in a filter or column above: a generator is not merged
    with what reads it."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(c) for c, v in values.items())))))


def scan_case_table(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(cases, bad rows) of a case table whose nested columns are written as text (JSON, or literals with single
    quotes, ``None`` and ``nan``).

    Cases have typed maps, lists and records, and ranges as numbers; a missing nested text is NULL. A row goes to the
    bad rows, once, with the names of the columns at fault (``bad``) and its texts as they are, if a nested text can't be
    read, a range is no number, or the record itself is broken (``record``). Of a key written twice the last entry stays. Fields hold line breaks in CSV, so a
    CSV file is read by one task; JSON lines are split."""
    columns = [*CASE_FIELDS, *CASE_COLUMNS]
    schema = ", ".join(f"{c} string" for c in columns) + ", _record string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    raw = reader.format(fmt).load(path)

    def literal(c):
        none = "None|nan" if c in RANGES else "None"
        has_none = F.col(c).contains("None") | F.col(c).contains("nan")
        return F.when(has_none, F.regexp_replace(F.col(c), rf"([:,\[]\s*)(?:{none})(?=\s*[,}}\]])", "$1null")).otherwise(F.col(c))

    # texts are parsed once a row: the faults and the values below read the parsed columns
    texts = raw.select(*(F.when(F.trim(c).isin("", *MISSING_TEXTS), None).otherwise(F.col(c)).alias(c) for c in columns), "_record")
    typed = _computed_once(texts, {f"_p_{c}": F.from_json(literal(c), t, _JSON) for c, t in CASE_COLUMNS.items()})
    typed = _computed_once(typed, {f"_t_{c}": _last_wins(F.col(f"_p_{c}")) if t.startswith("map") else F.col(f"_p_{c}") for c, t in CASE_COLUMNS.items()})

    def fault(c):
        unread = F.col(c).isNotNull() & F.col(f"_t_{c}").isNull()
        if c in RANGES:
            unread = unread | F.coalesce(F.exists(F.map_values(f"_t_{c}"), lambda v: v.isNotNull() & v.try_cast("double").isNull()), F.lit(False))
        return F.when(unread, F.lit(c))

    faults = F.array_compact(F.array(F.when(F.col("_record").isNotNull(), F.lit("record")), *(fault(c) for c in CASE_COLUMNS)))
    typed = typed.withColumn("bad", faults)
    values = [F.transform_values(f"_t_{c}", lambda _, v: v.try_cast("double")) if c in RANGES else F.col(f"_t_{c}") for c in CASE_COLUMNS]
    good = typed.where(F.size("bad") == 0).select(*CASE_FIELDS, *(v.alias(c) for c, v in zip(CASE_COLUMNS, values)))
    return good, typed.where(F.size("bad") > 0).select(*columns, "bad")


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON-lines sample list, by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.json(path)


def read_sample_config(spark: SparkSession, config: str | dict) -> DataFrame:
    """Task -> sample count (-1 = all) as a small DataFrame (broadcast later)."""
    if isinstance(config, str):
        config = json.loads(spark.read.text(config, wholetext=True).first()[0])
    return spark.createDataFrame([(k, int(v)) for k, v in config.items()], "task string, quota bigint")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet written, by key (anti join, not a row-count slice)."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def cache_valid(current: DataFrame, cached: DataFrame, cols: list[str]) -> DataFrame:
    """One row (n_current, n_cached, valid): valid when the counts agree and
    every (cols) row of the current set is in the cache."""
    a = current.select(*cols)
    b = cached.select(*cols)
    missing = a.exceptAll(b).select(F.count(F.lit(1)).alias("n_missing"))
    n = a.select(F.count(F.lit(1)).alias("n_current")).crossJoin(b.select(F.count(F.lit(1)).alias("n_cached")))
    return n.crossJoin(missing).select(
        "n_current", "n_cached", ((F.col("n_current") == F.col("n_cached")) & (F.col("n_missing") == 0)).alias("valid"))


def shard(df: DataFrame, n: int, i: int, order: list[Column]) -> DataFrame:
    """The i-th contiguous slice (``len // n + 1`` rows each) in ``order``, a total
    order. The global position comes from range-partitioned segments, never one task."""
    from tidemark.operators.ordering import dense_positions
    total = df.select(F.count(F.lit(1)).alias("_n"))
    ranked = dense_positions(df.withColumn("_g0", F.lit(0)), ["_g0"], order, "_rank")
    size = F.floor(F.col("_n") / n) + 1
    return ranked.crossJoin(F.broadcast(total)).where(F.floor((F.col("_rank") - 1) / size) == i).select(*df.columns)
