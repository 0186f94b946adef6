"""Interval joins of event ranges: events in buckets of neighbours, ranges cut at bucket ends.

A range [begin, end) of a subject's events meets whole buckets of ``width`` events instead of single ones, so
a long range is a few rows of the join, keyed by (subject, bucket): a busy subject is as many
keys as it has buckets. What lies outside the range is dropped right behind the join, before
anything is shuffled again. Ranges are made distinct first: samples that share one (several tasks
of an event) get its events once and take the result by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 16


def bucketed(events: DataFrame, values: list[str], subject: str = "subject_id", idx: str = "event_idx", width: int = WIDTH,
             partitions: int | None = None) -> DataFrame:
    """(subject, bucket, found): the events of each bucket with their index ``i`` and values; in ``partitions``, if given, which a
    join of ranges keeps."""
    own = events.withColumn("bucket", F.floor(F.col(idx) / width))
    if partitions:
        own = own.repartition(partitions, subject, "bucket")
    return (own.groupBy(subject, "bucket")
            .agg(F.collect_list(F.struct(F.col(idx).alias("i"), *values)).alias("found")))


def events_in(ranges: DataFrame, buckets: DataFrame, begin: Column, end: Column, subject: str = "subject_id", width: int = WIDTH) -> DataFrame:
    """``ranges`` with ``found``, the events in [begin, end): a row for each bucket that has any."""
    cut = ranges.withColumns({"_from": begin, "_to": end}).where(F.col("_to") > F.col("_from"))
    cut = cut.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    mine = F.filter("found", lambda e: (e["i"] >= F.col("_from")) & (e["i"] < F.col("_to")))
    return (cut.join(buckets, [subject, "bucket"]).withColumn("found", mine).where(F.size("found") > 0)
            .drop("_from", "_to", "bucket"))
