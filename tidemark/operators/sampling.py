"""D family: sample selection, weighting and mixing.

Randomness is always a deterministic md5-keyed ``u`` (``functions.keys.uniform``),
never ``rand()``, so results do not depend on partitioning or retries.

``keyed_top_n`` is the workhorse: the exact n smallest scores per group without
ranking a whole group in one task. Scores in [0, 1) are bucketed; a small
per-(group, bucket) histogram gives the cut bucket; only rows of that one bucket
are ranked. A hot group (a third of all rows) is therefore spread over the
buckets instead of one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket_of, quantile_bounds
from tidemark.functions.keys import uniform
from tidemark.session import materialize

SAMPLE_KEY = ["subject_id", "event_idx", "task"]
CODE_TASKS = ("procedures_icd", "procedures_ccs", "diagnoses_icd", "diagnoses_ccs")


def keyed_top_n(df: DataFrame, group: list[str], score: str, n_col: str, tiebreak: list[str],
                buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """Rows with the ``n`` smallest ``score`` per group; ``n`` is a column (NULL or
    negative = keep all). Exact; ties broken by ``tiebreak``. Equal slices of [0, 1)
    are the buckets unless ``bucket``, a number that rises with the score, is given."""
    b = bucket if bucket is not None else F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)).cast("int")
    d = df.withColumn("_b", b)
    hist = d.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_incl", F.sum("_cnt").over(w)).withColumn("_before", F.col("_incl") - F.col("_cnt"))
    # the histogram is (groups x buckets) rows: bounded by the bucket count per group
    j = d.join(hist, [*group, "_b"])
    n = F.col(n_col)
    keep_all = n.isNull() | (n < 0) | (F.col("_incl") <= n)
    boundary = (F.col("_before") < n) & (F.col("_incl") > n)
    # buckets ahead of the cut stay and those beyond go, both unsorted; the cut bucket alone, about
    # 1/buckets of its group, is ranked and its head stays
    wb = Window.partitionBy(*group, "_b").orderBy(F.col(score), *[F.col(c) for c in tiebreak])
    whole = j.where(keep_all)
    head = j.where(boundary).withColumn("_r", F.row_number().over(wb)).where(F.col("_r") <= n - F.col("_before"))
    return whole.select(*df.columns).unionByName(head.select(*df.columns))


# --- D1 / D2 ------------------------------------------------------------------
def target_freq(index: DataFrame) -> DataFrame:
    """Per task, how many samples carry each target value (lists exploded)."""
    return (index.select("task", F.explode("target").alias("target_value"))
            .groupBy("task", "target_value").agg(F.count(F.lit(1)).alias("n")))


def target_weight(index: DataFrame, key: list[str] = SAMPLE_KEY) -> DataFrame:
    """weight = 1 / mean frequency of the sample's targets. Samples with the same list of targets have the same
    weight, so lists are counted first (combined before the shuffle: two rows a yes/no task), and values inside the distinct lists;
    the join back is by a hash of the list with the list itself beside it, split by adaptive execution where a list is hot."""
    tag = F.xxhash64("task", "target")
    lists = index.where(F.size("target") > 0).groupBy("task", "target").agg(F.count(F.lit(1)).alias("_c"))
    values = lists.select("task", "target", "_c", F.explode("target").alias("_v"))
    freq = values.groupBy("task", F.xxhash64("_v").alias("_vh"), "_v").agg(F.sum("_c").alias("_n"))
    w = (values.withColumn("_vh", F.xxhash64("_v")).join(freq, ["task", "_vh", "_v"])
         .groupBy("task", "target").agg((1.0 / F.avg("_n")).alias("target_weight")).withColumn("_tag", tag))
    return index.withColumn("_tag", tag).join(w, ["task", "_tag", "target"], "left").drop("_tag").select(*index.columns, "target_weight")


# --- D3 - D8: filters ----------------------------------------------------------
def subject_split(index: DataFrame, subjects: DataFrame, col: str = "subject_id") -> DataFrame:
    """D3: keep samples of listed subjects (semi join)."""
    return index.join(subjects.select(col).distinct(), col, "left_semi")


def context_length_filter(index: DataFrame, lo: int = 10, hi: int = 100) -> DataFrame:
    """Lo < end - begin < hi (both strict)."""
    n = F.col("context_end") - F.col("context_begin")
    return index.where((n > lo) & (n < hi))


def admission_cover_filter(index: DataFrame, tasks=CODE_TASKS) -> DataFrame:
    """For the code tasks keep samples whose admission lies inside the context."""
    ok = F.col("admissions_id").isNull() | (F.col("admissions_id") > F.col("context_begin"))
    return index.where(~F.col("task").isin(*tasks) | ok)


def exclude_known(index: DataFrame, known: DataFrame, keys=("task", "subject_id", "context_end")) -> DataFrame:
    """Drop samples already present in another index (anti join on real columns)."""
    k = known
    if "period_end" in k.columns:
        k = k.withColumnRenamed("period_end", "context_end").withColumnRenamed("period_begin", "context_begin")
    return index.join(k.select(*keys).distinct(), list(keys), "left_anti")


def in_label_filter(index: DataFrame, reference: DataFrame) -> DataFrame:
    """Keep samples whose whole target was seen for the task in ``reference``;
    tasks absent from the reference pass unchanged."""
    ref = reference.select(F.col("task").alias("_rtask"), F.col("target").alias("_t")).distinct()
    ref_tasks = reference.select("task").distinct()
    seen = index.join(ref, (F.col("task") == F.col("_rtask")) & (F.col("target") == F.col("_t")), "left_semi")
    unseen_task = index.join(ref_tasks, "task", "left_anti")
    return seen.unionByName(unseen_task)


def label_len_filter(index: DataFrame, tasks=("chartevents",), max_len: int = 10) -> DataFrame:
    """For the listed tasks keep samples with fewer than ``max_len`` targets."""
    return index.where(~F.col("task").isin(*tasks) | (F.size("target") < max_len))


# --- D9 - D12: quota and sampling -------------------------------------------------
def resolve_quota(counts: DataFrame, config: DataFrame, force: float | None = None) -> DataFrame:
    """(task, n_available) x config(task, quota) -> n_take; -1 = all; tasks not
    in the config are dropped; ``force`` >= 1 is a fixed count, < 1 a fraction."""
    q = F.col("quota")
    if force is not None:
        q = F.lit(int(force)) if force >= 1 else F.floor(F.col("quota") * F.lit(force)).cast("bigint")
    j = counts.join(F.broadcast(config), "task").withColumn("quota", q.cast("bigint"))
    take = F.when((F.col("quota") > 0) & (F.col("quota") < F.col("n_available")), F.col("quota"))
    return j.withColumn("n_take", take)


def sample_uniform(index: DataFrame, quota: DataFrame, seed: int = 42, key: list[str] = SAMPLE_KEY) -> DataFrame:
    """Without replacement, n_take per task (NULL = keep all)."""
    d = index.join(F.broadcast(quota.select("task", "n_take")), "task").withColumn("_u", uniform(seed, *key))
    return keyed_top_n(d, ["task"], "_u", "n_take", key).drop("_u", "n_take")


def weighted_score(u, w):
    """Efraimidis-Spirakis key -ln(u)/w mapped monotonically into (0, 1)."""
    k = -F.log(u) / w
    return F.atan(F.log(k)) / F.lit(math.pi) + F.lit(0.5)


def sample_weighted(index: DataFrame, quota: DataFrame, seed: int = 42, weight: str = "target_weight",
                    key: list[str] = SAMPLE_KEY) -> DataFrame:
    """Weighted sampling without replacement (keyed exponential trick). The scores of
    a hot label's equal weights crowd together, so the buckets are quantiles of the scores."""
    buckets = 1024
    # tasks that are taken whole need no scores; the others are read for the bounds, the histogram and the rows
    asked = materialize(index.join(F.broadcast(quota.select("task", "n_take")), "task"))
    capped = F.coalesce(F.col("n_take") >= 0, F.lit(False))
    d = materialize(asked.where(capped).withColumn("_s", weighted_score(uniform(seed, *key), F.col(weight))))
    # one row for each task of the sampling configuration
    bounds = F.broadcast(d.groupBy("task").agg(quantile_bounds("_s", buckets).alias("_bounds")))
    head = keyed_top_n(d.join(bounds, "task").withColumn("_bk", bucket_of("_s", "_bounds", buckets)).drop("_bounds"),
                       ["task"], "_s", "n_take", key, bucket=F.col("_bk")).drop("_s", "_bk", "n_take")
    return asked.where(~capped).drop("n_take").unionByName(head)


def sample_balanced(index: DataFrame, quota: DataFrame, seed: int = 42, key: list[str] = SAMPLE_KEY) -> DataFrame:
    """N // k per label (k = labels present for the task); shortfall kept whole."""
    k = index.groupBy("task").agg(F.countDistinct("target").alias("_k"))
    q = quota.join(k, "task").select("task", F.when(F.col("n_take").isNotNull(),
                                                    F.floor(F.col("n_take") / F.col("_k"))).alias("_per"))
    d = index.join(F.broadcast(q), "task").withColumn("_u", uniform(seed, *key)).withColumn("_lbl", F.col("target"))
    return keyed_top_n(d, ["task", "_lbl"], "_u", "_per", key).drop("_u", "_per", "_lbl")


INDEX_COLUMNS = ["subject_id", "hadm_id", "task", "event", "period_begin", "period_end", "admissions_id",
                 "last_discharge_id", "target"]


def project_index(*parts: DataFrame) -> DataFrame:
    """Union the per-task samples; context_* -> period_*; fixed 9 columns."""
    out = None
    for p in parts:
        p = p.withColumnRenamed("context_begin", "period_begin").withColumnRenamed("context_end", "period_end")
        p = p.select(*INDEX_COLUMNS)
        out = p if out is None else out.unionByName(p)
    return out


def task_report(index: DataFrame) -> DataFrame:
    """Samples per task plus a total row (task = 'TOTAL')."""
    return (index.rollup("task").agg(F.count(F.lit(1)).alias("n_samples"))
            .select(F.coalesce("task", F.lit("TOTAL")).alias("task"), "n_samples"))


# --- D15 - D19: mixing and splits ---------------------------------------------------
def shuffle_mix(a: DataFrame, b: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """Seeded shuffle of the concatenation; ``mix_key`` orders the result
    (a range-partitioned global sort, no single-partition window)."""
    u = uniform(seed, F.col("source"), *key)
    return a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b"))) \
        .withColumn("mix_key", u).orderBy("mix_key", "source", *key)


def curriculum_mix(a: DataFrame, b: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """The second set's share ramps up linearly after theta = 1 - 2 n_b / n_a.

    Closed form (re-aimed; same density, not the same draw sequence): b rows sit at
    t = theta + (1 - theta) sqrt(u); a rows follow the complementary density on
    [0, 1]. theta is clamped at 0; n_a = 0 is rejected (theta undefined)."""
    n = (a.select(F.count(F.lit(1)).alias("n_a")).crossJoin(b.select(F.count(F.lit(1)).alias("n_b"))))
    theta = F.greatest(F.lit(0.0), F.lit(1.0) - 2.0 * F.col("n_b") / F.col("n_a"))
    ua = uniform(seed, F.lit("a"), *key)
    ub = uniform(seed, F.lit("b"), *key)
    tb = theta + (F.lit(1.0) - theta) * F.sqrt(ub)
    # a: density 1 on [0, theta), (1 - s) on [theta, 1] where s ramps 0 -> 1;
    # inverse CDF of that piecewise density (mass theta + (1 - theta) / 2).
    mass = theta + (F.lit(1.0) - theta) / 2.0
    v = ua * mass
    ta = F.when(v < theta, v).otherwise(
        F.lit(1.0) - (F.lit(1.0) - theta) * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - 2.0 * (v - theta) / (F.lit(1.0) - theta))))
    a2 = a.crossJoin(F.broadcast(n)).withColumn("source", F.lit("a")).withColumn("t", ta)
    b2 = b.crossJoin(F.broadcast(n)).withColumn("source", F.lit("b")).withColumn("t", tb)
    return a2.unionByName(b2).drop("n_a", "n_b").orderBy("t", "source", *key)


def keep_multiple(df: DataFrame, seed: int, key: list[str], m: int = 64, size: int | None = None) -> DataFrame:
    """Random down-sample to the largest multiple of ``m`` (or a fixed size)."""
    cnt = df.select(F.count(F.lit(1)).alias("_n"))
    n_keep = F.lit(size) if size is not None else F.col("_n") - F.col("_n") % m
    d = (df.crossJoin(F.broadcast(cnt)).withColumn("_keep", n_keep.cast("bigint"))
         .withColumn("_u", uniform(seed, *key)).withColumn("_g", F.lit(0)))
    return keyed_top_n(d, ["_g"], "_u", "_keep", key).drop("_n", "_keep", "_u", "_g")


def split_filter(df: DataFrame, split: str = "train", col: str = "split") -> DataFrame:
    """Rows of one split; a missing split counts as train."""
    return df.where(F.coalesce(F.col(col), F.lit("train")) == split)


def random_split(df: DataFrame, seed: int, key: list[str], test_size: float = 0.001) -> DataFrame:
    """md5-keyed train/test assignment (independent of partitioning)."""
    return df.withColumn("split", F.when(uniform(seed, *key) < test_size, F.lit("test")).otherwise(F.lit("train")))


def make_candidates(index: DataFrame, vocab: DataFrame, similar: DataFrame, seed: int = 42, limit: int = 100,
                    key: list[str] = SAMPLE_KEY, event_kinds: tuple[str, ...] = ()) -> DataFrame:
    """Candidate answers per sample, sorted and distinct. Risk tasks: [no, yes]. next_event: ``event_kinds``. Tasks with at most
    ``limit`` known items: all of them. Otherwise ``limit`` keyed-sampled entries of
    the pooled neighbour lists of the labels, plus the labels. NULL for a task without known items.

    ``vocab``: (task, item), the known items; ``similar``: (task, item, neighbour). ``key`` holds the task."""
    sizes = vocab.groupBy("task").agg(F.count(F.lit(1)).alias("_nv"))
    small = vocab.join(sizes.where(F.col("_nv") <= limit), "task").groupBy("task") \
        .agg(F.array_sort(F.collect_list("item")).alias("_all"))
    # bounded: only tasks with <= limit items reach this table
    idx = index.join(F.broadcast(small), "task", "left").join(F.broadcast(sizes), "task", "left")
    kinds = F.array_sort(F.array(*map(F.lit, event_kinds))) if event_kinds else F.lit(None).cast("array<string>")
    whole = (F.when(F.col("task_type") == "risk_prediction", F.array(F.lit("no"), F.lit("yes")))
             .when(F.col("task") == "next_event", kinds).otherwise(F.col("_all")))
    idx = idx.withColumn("candidates", whole)
    sampled = F.col("candidates").isNull() & (F.coalesce("_nv", F.lit(0)) > limit)
    direct = idx.where(~sampled).select(*key, "candidates")
    lab = idx.where(sampled).select(*key, F.explode("target").alias("item"))
    # pooled neighbours of all labels of a sample, then up to ``limit`` of the pool
    pool = (lab.join(similar, ["task", "item"]).withColumn("_u", uniform(seed, *key, "item", "neighbour"))
            .withColumn("_lim", F.lit(limit)))
    picked = keyed_top_n(pool, key, "_u", "_lim", ["item", "neighbour"])
    cands = picked.select(*key, F.col("neighbour").alias("c")).unionByName(lab.select(*key, F.col("item").alias("c")))
    found = cands.groupBy(*key).agg(F.array_sort(F.collect_set("c")).alias("candidates"))
    return direct.unionByName(found)
