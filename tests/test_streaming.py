"""The streamed scored log processes each answer file once and resumes."""

import os
import tempfile

from pyspark.sql import functions as F

from tidemark.plans import bindings as b
from tidemark.spec import task_frame
from tidemark.streaming.scored_log import start_scored_log
from conftest import SF_SMALL


def test_scored_log_resumes(spark):
    root = tempfile.mkdtemp(prefix="tidemark-stream-")
    answers, out, ckpt = (os.path.join(root, d) for d in ("answers", "out", "ckpt"))
    idx = b.task_index(spark, SF_SMALL).join(task_frame(spark).select("task", "metric"), "task")
    preds = idx.select("subject_id", "event_idx", "task", F.array_join("target", "\n").alias("prediction"))
    first, second = preds.where(F.col("subject_id") % 2 == 0), preds.where(F.col("subject_id") % 2 == 1)
    first.write.json(os.path.join(answers, "part1"))
    q = start_scored_log(spark, os.path.join(answers, "*"), idx, out, ckpt)
    q.awaitTermination()
    n1 = spark.read.parquet(out).count()
    second.write.json(os.path.join(answers, "part2"))
    q = start_scored_log(spark, os.path.join(answers, "*"), idx, out, ckpt)
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert n1 == first.count()
    assert got.count() == preds.count()  # second run only added the new file
    # a perfect prediction scores 1 on every metric that defines a score
    assert got.where(F.coalesce("f1", "acc") < 1.0).count() == 0
