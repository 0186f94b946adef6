"""Results must not depend on the shuffle partition count (keyed randomness only)."""

import pytest

from tidemark.plans import catalog
from conftest import SF_SMALL
from test_oracle import _digest

KEYS = ["b_runs", "c_task_index", "d_sample_weighted", "d_sample_balanced", "d_keep_multiple", "f_topk_pairs",
        "g_auroc", "a_shard"]


@pytest.mark.parametrize("key", KEYS)
def test_same_result_for_1_and_200_partitions(spark, key):
    q = catalog.queries()[key]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        digests = []
        for n in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, SF_SMALL)
            digests.append(_digest([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert digests[0] == digests[1]


def by_windows(rows):
    """The timeline's positions and runs from windows over whole subjects."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    kind = F.col("file_name")
    timed = F.col("ts_us").isNotNull() & ~kind.isin("patients", "diagnoses_icd", "drgcodes")
    key = F.struct("ts_us", "source_rank", "file_name", "row_id")
    anchor = F.max(F.when(timed, key)).over(Window.partitionBy("subject_id", "hadm_id"))
    rows = rows.withColumn("_a", F.when(timed, key).when(kind.isin("diagnoses_icd", "drgcodes"), anchor))
    place = F.when(kind == "patients", 0).when(F.col("_a").isNotNull(), 1).otherwise(2)
    tail = F.when(timed, 0).when(kind == "diagnoses_icd", 1).when(kind == "drgcodes", 2).otherwise(3)
    w = Window.partitionBy("subject_id")
    rows = rows.withColumn("pos", F.row_number().over(w.orderBy(place, "_a", tail, "row_id", kind)).cast("bigint"))
    before = F.lag("file_name").over(w.orderBy("pos"))
    rows = rows.withColumn("_n", F.when(before == kind, 0).otherwise(1))
    return rows.withColumn("event_idx", F.sum("_n").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1)


def test_segmented_ordering_equals_windows(spark):
    """The segmented ordering and the block-wise runs give the positions and runs of windows,
    also when one subject holds a third of all rows."""
    from pyspark.sql import functions as F

    from tidemark.operators import timeline as tl
    from tidemark.plans import bindings as b
    rows = b.decoded_rows(spark, SF_SMALL)
    hot = (rows.withColumn("subject_id", F.when(F.col("subject_id") % 3 == 0, F.lit(0)).otherwise(F.col("subject_id")))
           .where(~((F.col("subject_id") == 0) & (F.col("file_name") == "patients"))))
    cols = ["subject_id", "row_id", "file_name", "pos", "event_idx"]
    for df in (rows, hot):
        want = by_windows(df).select(*cols)
        for got in (tl.order_and_mark(df, partitions=16), tl.mark_runs(tl.order_timeline(df, partitions=3), block_rows=7), tl.mark_runs(tl.order_timeline(df))):
            got = got.select(*cols)
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_runs_split_on_visit(spark):
    from tidemark.operators import timeline as tl
    rows = [(1, p, "a" if p < 5 else "b", v) for p, v in enumerate([1, 1, 2, None, None, None, 3, 3, 3], 1)]
    df = spark.createDataFrame(rows, "subject_id long, pos long, file_name string, hadm_id long")
    for block in (1, 2, 3, 100):
        got = [r.event_idx for r in tl.mark_runs(df, split_on_visit=True, block_rows=block).orderBy("pos").collect()]
        assert got == [0, 0, 1, 2, 3, 3, 4, 4, 4]
        assert [r.event_idx for r in tl.mark_runs(df, block_rows=block).orderBy("pos").collect()] == [0] * 4 + [1] * 5
