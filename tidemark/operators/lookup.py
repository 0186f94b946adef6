"""Dictionary decoding by left joins; the planner and adaptive execution choose how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.joins import lookup


def lookup_versioned(df: DataFrame, dim: DataFrame, version: str = "icd_version", code: str = "icd_code",
                     out: str = "long_title") -> DataFrame:
    """(version, code) -> title; unknown -> NULL. Codes compared as text."""
    d = dim.select(F.col(version).cast("string").alias(version), F.col(code).cast("string").alias(code), out)
    return lookup(df.withColumn(version, F.col(version).cast("string")).withColumn(code, F.col(code).cast("string")),
                  d, [version, code])


def ndc_key(ndc) -> object:
    """E2 key: drop the decimal part, left-pad to 11 digits; longer codes unchanged
    (Spark's lpad would truncate them)."""
    head = F.substring_index(F.col(ndc) if isinstance(ndc, str) else ndc, ".", 1)
    return F.when(F.length(head) >= 11, head).otherwise(F.lpad(head, 11, "0"))


def dedup_last(dim: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key; the last duplicate (highest ``order``) wins. A partial
    aggregation (``max_by``), so a heavily duplicated key is combined map-side."""
    cols = [c for c in dim.columns if c != key]
    best = dim.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def lookup_ndc(df: DataFrame, dim: DataFrame, ndc: str = "ndc", out: str = "atc_name") -> DataFrame:
    """Ndc text -> drug class via the padded key."""
    return lookup(df.withColumn("ndc_key", ndc_key(ndc)), dim.select(F.col("ndc_code").alias("ndc_key"), out), "ndc_key")


def lookup_item(df: DataFrame, dim: DataFrame, key: str, out: str) -> DataFrame:
    """Plain key -> label."""
    return lookup(df, dim.select(key, out), key)


def multi_value_dim(detail: DataFrame, key: str, field: str, value: str, wanted: str) -> DataFrame:
    """A11 / E3 multi: rows of one field grouped per key into a sorted distinct list."""
    return (detail.where(F.col(field) == wanted).groupBy(key)
            .agg(F.array_sort(F.collect_set(value)).alias("values")))
