"""F family: event concepts, history concepts, co-occurrence, lift, top-k.

Sizes: a sample's history is the concepts of its context events. Concepts that are too
rare for any lift are dropped from the histories before target x history pairs are
emitted, per sample (an equi-join on the sample key, never a cross join), and pairs are
aggregated per task right away; the second look at the pairs (F8) starts from the strong ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv


SAMPLE = ["subject_id", "event_idx", "task"]


def event_concepts(targets: DataFrame, list_tasks: tuple[str, ...]) -> DataFrame:
    """long table (subject, event, concept) of the list-valued decision targets."""
    return (targets.where(F.col("task").isin(*list_tasks))
            .select("subject_id", F.col("event_idx").alias("h_idx"), F.explode("target").alias("concept"))
            .distinct())


def history_concepts(samples: DataFrame, concepts: DataFrame) -> DataFrame:
    """distinct history concepts per sample: of [begin, end), the last discharge and the admission.

    Samples of one event share a history, which is found once by an interval join on buckets of events."""
    asked = samples.select(*SAMPLE, F.col("context_begin").cast("bigint").alias("_b"), F.col("context_end").cast("bigint").alias("_e"),
                           F.col("last_discharge_id").cast("bigint").alias("_d"), F.col("admissions_id").cast("bigint").alias("_a"))
    shared = ["subject_id", "_b", "_e", "_d", "_a"]
    ends = F.array(*(F.struct(b.alias("begin"), e.alias("end")) for b, e in ((F.col("_b"), F.col("_e")), (F.col("_d"), F.col("_d") + 1),
                                                                          (F.col("_a"), F.col("_a") + 1))))
    ranges = asked.select(*shared).distinct().select(*shared, F.explode(ends).alias("r"))
    found = iv.events_in(ranges, iv.bucketed(concepts, ["concept"], idx="h_idx"), F.col("r.begin"), F.col("r.end"))
    held = (found.select(*shared, F.explode(F.array_distinct(F.transform("found", lambda x: x["concept"]))).alias("concept")).distinct()
            .select(*(F.col(c).alias(f"_of{c}") for c in shared), "concept"))
    same = F.lit(True)
    for c in shared:
        same = same & asked[c].eqNullSafe(F.col(f"_of{c}"))
    return asked.join(held, same).select(*SAMPLE, "concept")


def target_concepts(samples: DataFrame, list_tasks: tuple[str, ...]) -> DataFrame:
    return (samples.where(F.col("task").isin(*list_tasks))
            .select(*SAMPLE, F.explode("target").alias("concept")).distinct())


def concept_num(samples: DataFrame, targets_long: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples per (task, concept) over target u history, and samples per task."""
    n_c = (targets_long.unionByName(history).distinct()
           .groupBy("task", "concept").agg(F.count(F.lit(1)).alias("n")))
    n_task = samples.groupBy("task").agg(F.count(F.lit(1)).alias("n_samples"))
    return n_c, n_task


def supported(history: DataFrame, n_c: DataFrame, min_support: int = 5) -> DataFrame:
    """History concepts that enough samples of their task have: only these can have a lift."""
    return history.join(n_c.where(F.col("n") >= min_support).select("task", "concept"), ["task", "concept"], "left_semi").select(*SAMPLE, "concept")


def coexist(targets_long: DataFrame, history: DataFrame) -> DataFrame:
    """samples with (target t, history h), self pairs included (removed in F8)."""
    t = targets_long.withColumnRenamed("concept", "target_concept")
    h = history.withColumnRenamed("concept", "history_concept")
    return (t.join(h, SAMPLE).groupBy("task", "target_concept", "history_concept")
            .agg(F.count(F.lit(1)).alias("n_pair")))


def lift(pairs: DataFrame, n_c: DataFrame, n_task: DataFrame, min_support: int = 5) -> DataFrame:
    """n(t,h) * N / (n(h) * n(t)) where n(h) >= min_support. Support is applied
    to the concept table before it meets the pairs."""
    nh = n_c.where(F.col("n") >= min_support).select("task", F.col("concept").alias("history_concept"),
                                                     F.col("n").alias("n_h"))
    nt = n_c.select("task", F.col("concept").alias("target_concept"), F.col("n").alias("n_t"))
    j = (pairs.join(nh, ["task", "history_concept"]).join(nt, ["task", "target_concept"])
         .join(n_task, "task"))
    return j.withColumn("lift", F.col("n_pair") * F.col("n_samples") / (F.col("n_h") * F.col("n_t")))


def related_concepts(targets_long: DataFrame, history: DataFrame, lifts: DataFrame, threshold: float = 5.0,
                     topk: int = 20) -> DataFrame:
    """F8: per sample and target concept, history concepts (not itself) with
    lift > threshold, best ``topk`` by lift (ties by concept)."""
    t = targets_long.withColumnRenamed("concept", "target_concept")
    h = history.withColumnRenamed("concept", "history_concept")
    strong = (lifts.where((F.col("lift") > threshold) & (F.col("target_concept") != F.col("history_concept")))
              .select("task", "target_concept", "history_concept", "lift"))
    j = t.join(strong, ["task", "target_concept"]).join(h, [*SAMPLE, "history_concept"])
    w = Window.partitionBy(*SAMPLE, "target_concept").orderBy(F.desc("lift"), F.asc("history_concept"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)


def filter_paths(paths: DataFrame, related: DataFrame) -> DataFrame:
    """keep paths whose two ends are one target and one history concept of the
    sample, in either direction."""
    pairs = related.select(*SAMPLE, "target_concept", "history_concept")
    p = paths.select("src", "dst", "hops", "path")
    fwd = pairs.join(p, (F.col("target_concept") == F.col("src")) & (F.col("history_concept") == F.col("dst")))
    rev = pairs.join(p, (F.col("target_concept") == F.col("dst")) & (F.col("history_concept") == F.col("src")))
    cols = [*SAMPLE, "src", "dst", "hops", "path"]
    return fwd.select(*cols).unionByName(rev.select(*cols)).distinct()


def sample_evidence(samples: DataFrame, related: DataFrame, paths: DataFrame) -> DataFrame:
    """(subject_id, event_idx, task, evidence) for every sample.

    ``evidence`` is a record of ``related``, the pairs (target, history, lift) by target and rank, and ``paths``, those
    of :func:`filter_paths` by their nodes; NULL where the sample has no related pair or no path."""
    rel = related.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(F.struct(
        F.col("target_concept").alias("target"), "rank", F.col("history_concept").alias("history"), "lift"))).alias("_r"))
    kept = filter_paths(paths.where(F.col("path").isNotNull()), related).groupBy(*SAMPLE).agg(F.array_sort(F.collect_set("path")).alias("_p"))
    record = F.struct(F.transform("_r", lambda r: F.struct(r["target"].alias("target"), r["history"].alias("history"), r["lift"].alias("lift")))
                      .alias("related"), F.col("_p").alias("paths"))
    joined = samples.select(*SAMPLE).join(rel.join(kept, SAMPLE), SAMPLE, "left")
    return joined.select(*SAMPLE, F.when(F.col("_p").isNotNull(), record).alias("evidence"))
