"""A family sinks. Everything is written by executors; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BUCKETS = 64


def subject_bucket(subject: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(subject).cast("string")), F.lit(buckets)).cast("int")


def write_by_patient(df: DataFrame, path: str, subject: str = "subject_id", buckets: int = BUCKETS, order: tuple[str, ...] = ()) -> None:
    """A4: rows in directories by a hash of the subject, sorted by subject inside each file, instead of one file per
    patient.

    ``buckets=n/bucket=k`` are partition columns, so a read of listed subjects opens their buckets only, and in them the
    row groups that hold a subject (:func:`ingest.read_subjects`). The rebalance hint leaves the number of files to the data: a
    bucket with a subject of a third of all rows is split over several writers, small ones share one."""
    cols = [c for c in df.columns if c not in ("buckets", "bucket")]
    laid = df.select(*cols, F.lit(buckets).alias("buckets"), subject_bucket(subject, buckets).alias("bucket"))
    (laid.hint("rebalance", "bucket").sortWithinPartitions("bucket", subject, *order)
     .write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path))


def write_trajectory(events: DataFrame, path: str, items: str = "items", buckets: int = BUCKETS) -> None:
    """A5: event table with ``items`` as JSON text (exchange format only), laid out by subject."""
    write_by_patient(events.withColumn(items, F.to_json(items)), path, buckets=buckets, order=("event_idx",))


def write_task_index(index: DataFrame, path: str, by: str = "task") -> None:
    """One directory per task (``partitionBy``), or files clustered by subject.

    The rebalance hint leaves file count and size to the data: adaptive execution splits a
    task or subject with many rows over several writers and merges small ones."""
    if by == "task":
        index.hint("rebalance", "task").write.mode("overwrite").partitionBy("task").parquet(path)
    else:
        (index.hint("rebalance", "subject_id").sortWithinPartitions("subject_id")
         .write.mode("overwrite").parquet(path))


def write_scored_log(scored: DataFrame, path: str) -> DataFrame:
    """Append scored outputs (JSON lines); returns the per-task count summary."""
    scored.write.mode("append").json(path)
    return scored.groupBy("task").agg(F.count(F.lit(1)).alias("n_scored"))
