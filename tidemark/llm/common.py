"""Helpers shared by the llm operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_SPACE = r"\x20\x09-\x0D"  # the white space between words, as a regex class body
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package and bound the Arrow batches they get.

    The package goes to the executors as a py-file (once per application), so the
    cluster needs no installation of it. Batches are bounded in rows and in bytes:
    a few very long texts then never make one huge batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        # the driver's own copy; Spark's file server hands it to the executors
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark"), "zip", root, "tidemark")
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable), however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About ``n`` rows (all, if there are no more; by four standard deviations fewer than ``n`` else, but a quarter
    of ``n`` at least), chosen by the hash of ``keys``: one count and a filter, so no task or driver gathers the rows."""
    total = df.count()
    if total <= n:
        return df
    cut = int(max(n - 4 * n ** 0.5, n / 4) / total * (1 << 64)) - (1 << 63)
    return df.where(F.xxhash64(*keys) < F.lit(cut))


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted to have ``max_rows`` narrow rows at most; the planner
    and adaptive execution choose the join else."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the component's smallest node.

    Alternating large-star and small-star steps until the edge set is stable; edges never
    exceed their first number and every round is checkpointed. The minima are materialized
    before they are joined back, so that the join is between two plain exchanges and
    adaptive execution can split a hub's edges. Null and self edges are ignored.
    """
    def stars(df, node, low):
        return df.where(F.col(node) != F.col(low)).select(F.col(node).alias("u"), F.col(low).alias("v")).distinct()

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    e = materialize(stars(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi, lo), "hi", "lo"))
    seen = state(e)
    while seen[0]:
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")),
                                          F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("s"))
        low = materialize(ends.groupBy(F.col("s.node").alias("v")).agg(F.least(F.min("s.other"), F.first("s.node")).alias("m")))
        large = materialize(stars(e.join(low, "v"), "u", "m"))
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        both = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("node"), F.col("m").alias("low")),
            F.struct(F.col("v").alias("node"), F.col("m").alias("low")))).alias("s")).select("s.*")
        e = materialize(stars(both, "node", "low"))
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
