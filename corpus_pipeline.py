"""The corpus pipeline: documents to packed training sequences, one written table per stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    return line_dedup.without_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("best_fit_packing", packing_stage)]

#: SQL has no XXH64 with a seed and no tokenizer: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Every stage on all that the one before kept; each result is written and read again, so that no stage
    is computed twice and a lost executor repeats one stage at most.

    With a ``name`` a lost driver loses one stage at most as well: a run of that name goes on behind the last stage that
    was written whole (without one, every run is its own). A stage's folder goes as soon as the next one
    is written; the last stage's is the result."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{name or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{stage_name}" for k, (stage_name, _) in enumerate(STAGES)]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [k for k, path in enumerate(paths) if files.exists(path_of(f"{path}/_SUCCESS"))]
    start = done[-1] + 1 if done else 0
    docs = spark.read.parquet(paths[start - 1]) if start else table(spark, sf_dir, "documents")
    for k in range(start, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            files.delete(path_of(paths[k - 1]), True)
    return docs
