"""A16 + A22 as a stream: score model answers as they arrive, exactly once.

Answers land as JSON files (subject_id, event_idx, task, prediction). The stream
joins each micro-batch with the (static) task index, scores it with the batch
operator ``score_by_metric`` and writes the batch under ``batch_id=<n>``
(overwrite of that directory only), so a retried batch replaces itself and the
checkpoint remembers which files were done: the streaming counterpart of
"skip work already written".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scoring import score_by_metric

ANSWER_SCHEMA = "subject_id long, event_idx long, task string, prediction string"
KEY = ["subject_id", "event_idx", "task"]


def score_batch(answers: DataFrame, index: DataFrame) -> DataFrame:
    """Join answers to their samples (labels, metric) and score them."""
    j = answers.join(index.select(*KEY, "metric", F.col("target").alias("labels"),
                                  F.array_join("target", "|").alias("label_text")), KEY)
    return score_by_metric(j, KEY)


def start_scored_log(spark: SparkSession, answers_dir: str, index: DataFrame, out_dir: str, checkpoint: str,
                     available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(ANSWER_SCHEMA).json(answers_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(batch, index)
        scored.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
