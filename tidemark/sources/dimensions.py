"""Loaders of the code books, from delimited or JSON-lines files, with codes as text.

Codes are never inferred as numbers, so leading zeros stay. A book has one row a key: of repeated keys the last in
the files' order wins, found by a partial aggregation. Texts that mean 'missing' are NULL, rows without a key are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import MISSING_TEXTS
from tidemark.operators.lookup import dedup_last, multi_value_dim


def load_texts(spark: SparkSession, path: str | list[str], columns: dict[str, str], fmt: str = "csv") -> DataFrame:
    """The named columns (file name -> own name) as trimmed text; others are not kept."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"') if fmt == "csv" else \
        spark.read.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.format(fmt).load(path)
    texts = [F.trim(F.col(f"`{c}`").cast("string")).alias(name) for c, name in columns.items()]
    df = df.select(*texts, F.monotonically_increasing_id().alias("_at"))
    return df.withColumns({name: F.when(F.col(name).isin("", *MISSING_TEXTS), None).otherwise(F.col(name)) for name in columns.values()})


def load_book(spark: SparkSession, path: str | list[str], keys: dict[str, str], label: tuple[str, str], fmt: str = "csv") -> DataFrame:
    """A book of ``keys`` -> ``label``."""
    df = load_texts(spark, path, keys | dict([label]), fmt)
    names = list(keys.values())
    for k in names:
        df = df.where(F.col(k).isNotNull())
    whole = df.withColumn("_key", F.struct(*names)).drop(*names)
    return dedup_last(whole, "_key", "_at").select(*(F.col(f"_key.{k}").alias(k) for k in names), label[1])


def load_icd_dim(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """(icd_version, icd_code) -> long_title."""
    return load_book(spark, path, {"icd_version": "icd_version", "icd_code": "icd_code"}, ("long_title", "long_title"), fmt)


def load_atc_dim(spark: SparkSession, path: str | list[str], fmt: str = "csv", code: str = "ndc_code", name: str = "atc_name") -> DataFrame:
    """ndc_code -> atc_name; the last duplicate wins."""
    return load_book(spark, path, {code: "ndc_code"}, (name, "atc_name"), fmt)


def load_hcpcs_dim(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """hcpcs_cd -> short_description."""
    return load_book(spark, path, {"code": "hcpcs_cd"}, ("short_description", "short_description"), fmt)


def load_item_dim(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """A10: itemid -> label, of the lab or the ICU items."""
    return load_book(spark, path, {"itemid": "itemid"}, ("label", "label"), fmt)


def load_radiology_dim(spark: SparkSession, path: str | list[str], fmt: str = "csv", field: str = "exam_name") -> DataFrame:
    """note_id -> the sorted distinct values of one field."""
    df = load_texts(spark, path, {"note_id": "note_id", "field_name": "field_name", "field_value": "field_value"}, fmt)
    return multi_value_dim(df.where(F.col("note_id").isNotNull() & F.col("field_value").isNotNull()), "note_id", "field_name", "field_value", field)
