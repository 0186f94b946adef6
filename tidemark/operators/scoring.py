"""G family at DataFrame level: metric dispatch, ROUGE-1, voting, pass@k, AUROC.

Row-local scores are pure expressions (``functions.scoring``); the operators here
add the grouped parts. Nothing collects a whole group: voting aggregates
(group, answer) counts first; AUROC uses bucketed prefix sums over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.buckets import bucket_of, quantile_bounds
from tidemark.functions import scoring as fs
from tidemark.functions.text import extract_answer, split_prediction

SET_METRICS = ("em", "f1", "recall", "precision")


def rouge_tokens(text: Column | str) -> Column:
    """Unstemmed ROUGE tokens: lower-case, runs of [a-z0-9] only."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def _shared(a: Column, b: Column) -> Column:
    """How many entries two sorted lists share, each as often as both hold it: one merge, of as many steps as they have entries."""
    none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(at, _):
        x, y = F.get(a, at["i"]), F.get(b, at["j"])
        # behind the end of either list nothing is shared any more
        return F.struct((at["i"] + F.when(x <= y, 1).otherwise(0)).alias("i"), (at["j"] + F.when(y <= x, 1).otherwise(0)).alias("j"),
                        (at["n"] + F.when(x == y, 1).otherwise(0)).alias("n"))
    return F.aggregate(F.array_repeat(F.lit(0), F.size(a) + F.size(b)), none, step, lambda at: at["n"])


def rouge1_scores(ref: Column, pred: Column) -> Column:
    """G3 (unstemmed), for a row: struct of unigram overlap precision, recall and F1."""
    def scored(x):
        prec = F.when(x["p"] > 0, x["o"] / x["p"]).otherwise(F.lit(0.0))
        rec = F.when(x["r"] > 0, x["o"] / x["r"]).otherwise(F.lit(0.0))
        return F.struct(prec.alias("precision"), rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"))

    def sizes(t):
        overlap = _shared(t["r"], t["p"])
        return F.struct(F.coalesce(overlap, F.lit(0)).alias("o"), F.greatest(F.size(t["r"]), F.lit(0)).alias("r"), F.greatest(F.size(t["p"]), F.lit(0)).alias("p"))

    # lists of one: what a function is given is computed once, however often it is used
    tokens = F.array(F.struct(F.array_sort(rouge_tokens(ref)).alias("r"), F.array_sort(rouge_tokens(pred)).alias("p")))
    return F.element_at(F.transform(F.transform(tokens, sizes), scored), 1)


def rouge1(df: DataFrame, key: list[str], ref: str, pred: str) -> DataFrame:
    """G3 (unstemmed): unigram overlap precision / recall / F1 per row of ``df``."""
    return df.select(*key, rouge1_scores(F.col(ref), F.col(pred)).alias("_s")).select(*key, "_s.*")


SCORES = ("precision", "recall", "f1", "acc")


def metric_scores(metric: Column, labels: Column | str, label_text: Column | str, prediction: Column, category: Column | str | None = None) -> Column:
    """G5 + G6, for a row: struct of precision, recall, f1 and acc by metric, NULL where the metric does not define one. Set
    metrics score the split prediction with G1; ``rouge`` uses G3; ``acc``/``aucroc`` G2; ``cdm_diagnosis`` G1 plus G4."""
    def score(parts, acc):
        return F.struct(*(parts[c].alias(c) for c in SCORES[:3]), acc.alias("acc"))

    none = F.lit(None).cast("double")
    text = F.col(label_text) if isinstance(label_text, str) else label_text
    empty = {c: none for c in SCORES[:3]}
    diagnosis = F.when(metric == "cdm_diagnosis", fs.contains_acc(category, prediction)) if category is not None else none
    return (F.when(metric.isin(*SET_METRICS, "cdm_diagnosis"), score(fs.set_prf(labels, split_prediction(prediction)), diagnosis))
            .when(metric.isin("acc", "aucroc"), score(empty, fs.prefix_acc(text, prediction)))
            .when(metric == "rouge", score(rouge1_scores(text, prediction), none)))


def score_by_metric(df: DataFrame, key: list[str], metric: str = "metric", labels: str = "labels",
                    label_text: str = "label_text", prediction: str = "prediction", category: str | None = None
                    ) -> DataFrame:
    """G5 + G6: key, metric and the scores of :func:`metric_scores`; a row of an unknown metric is dropped. One projection."""
    scores = metric_scores(F.col(metric), labels, label_text, F.col(prediction), category)
    return df.select(*key, metric, scores.alias("_s")).where(F.col("_s").isNotNull()).select(*key, metric, "_s.*")


def score_multi(df: DataFrame, key: list[str], labels: str, predictions: str, metric: str = "metric", label_text: str = "label_text",
                category: str | None = None) -> DataFrame:
    """For a list of outputs a list of each score of the metric, in the outputs' order; ``{score}_list`` is NULL
    where the metric does not define the score."""
    each = F.transform(predictions, lambda p: metric_scores(F.col(metric), labels, label_text, p, category))
    rows = df.select(*key, metric, each.alias("_e"))

    def listed(c):
        values = F.transform("_e", lambda x: x[c])
        return F.when(F.exists(values, lambda v: v.isNotNull()), values)
    return rows.select(*key, metric, *(listed(c).alias(f"{c}_list") for c in SCORES))


def majority_vote(df: DataFrame, group: list[str], pos: str, answer: str, correct: str) -> DataFrame:
    """Most common answer per group (ties -> first seen), its correctness, the
    mean and any-correct accuracy, and the positions of right / wrong outputs."""
    counts = df.groupBy(*group, answer).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"),
                                            F.max(F.col(correct).cast("int")).alias("_ok"))
    # most frequent answer, earliest first occurrence on ties: a max over a struct
    # (partial aggregation; no window over all answers of a group)
    best = counts.groupBy(*group).agg(F.max(F.struct(F.col("_n"), (-F.col("_first")).alias("_nf"),
                                                     F.col(answer).alias("_a"), F.col("_ok").alias("_o"))).alias("_b"))
    vote = best.select(*group, F.col("_b._a").alias("vote_answer"), F.col("_b._o").cast("double").alias("vote_acc"))
    stats = df.groupBy(*group).agg(
        F.avg(F.col(correct).cast("double")).alias("avg_acc"),
        F.max(F.col(correct).cast("double")).alias("least_acc"),
        F.array_sort(F.collect_list(F.when(F.col(correct), F.col(pos)))).alias("positive"),
        F.array_sort(F.collect_list(F.when(~F.col(correct), F.col(pos)))).alias("negative"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("c"))
    return vote.join(stats, group)


def pass_at_k(df: DataFrame, group: list[str], n: str = "n", c: str = "c") -> DataFrame:
    """pass@k for k = 1..n per group."""
    return (df.select(*group, n, c, F.explode(F.sequence(F.lit(1), F.col(n))).alias("k"))
            .withColumn("pass_at_k", fs.pass_at_k(n, c, "k")))


# Dataset name -> score function, in registry order.
SCORE_REGISTRY = [
    ("medqa", "single_choice"), ("medmcqa", "single_choice"), ("mmlu", "single_choice"),
    ("pubmedqa", "single_choice"), ("bioasq", "single_choice"), ("medqa_5op", "single_choice"),
    ("mmlu_medcare", "single_choice"), ("medsins", "entity_match"), ("medqa_open", "entity_match"),
    ("medical_o1", "verifier"), ("open_mcqa", "verifier"),
]


def score_func_for(dataset: Column | str) -> Column:
    """Exact name, else the first registry name contained in it, else single choice."""
    d = F.col(dataset) if isinstance(dataset, str) else dataset
    expr = None
    for name, fn in SCORE_REGISTRY:
        expr = F.when(d == name, F.lit(fn)) if expr is None else expr.when(d == name, F.lit(fn))
    for name, fn in SCORE_REGISTRY:
        expr = expr.when(d.contains(name), F.lit(fn))
    return expr.otherwise(F.lit("single_choice"))


# Reasoning-filter phrases.
BANNED_HEADINGS = ("Extraction and Analysis", "Reasoning and Summary")
RESULT_MARKER = "Final Results"
GROUND_TRUTH = "ground truth"


def reasoning_filter(df: DataFrame, labels: str = "labels", reasonings: str = "reasonings",
                     min_ratio: float = 0.7, task: str = "task") -> DataFrame:
    """Drop the discharge task; keep reasonings whose tail (after the last
    'Final Results') contains >= 70 % of the labels, that never mention ground truth
    and contain neither banned heading; drop rows with none left."""
    def ok(r):
        tail = F.try_element_at(F.split(r, RESULT_MARKER), F.lit(-1))
        hits = F.size(F.filter(labels, lambda lab: tail.contains(lab)))
        ratio = hits / F.size(labels)
        banned = F.lit(False)
        for h in BANNED_HEADINGS:
            banned = banned | r.contains(h)
        return (ratio >= min_ratio) & ~F.lower(r).contains(GROUND_TRUTH) & ~banned
    kept = df.where(F.col(task) != "discharge").withColumn("kept", F.filter(reasonings, ok))
    return kept.where(F.size("kept") > 0)


def leaderboard(scores: DataFrame, group: str = "task", metric: str = "metric", score: str = "score", label: str = "label",
                probability: str = "probability") -> DataFrame:
    """(task, metric, score, n): the mean score of a task; for ``aucroc`` tasks the AUROC of the stored probabilities
    against 0/1 labels, NULL where a class is missing."""
    means = scores.groupBy(group, metric).agg(F.avg(score).alias("_mean"), F.count(F.lit(1)).alias("n"))
    areas = auroc(scores.where(F.col(metric) == "aucroc"), [group], probability, label).select(group, F.col("auroc").alias("_area"))
    return means.join(areas, group, "left").select(group, metric, F.when(F.col(metric) == "aucroc", F.col("_area")).otherwise(F.col("_mean")).alias("score"), "n")


def ordered_prefix(df: DataFrame, group: list[str], order: str, value: str, out: str,
                   buckets: int = 1024) -> DataFrame:
    """Exclusive prefix sum of ``value`` in ``order`` within ``group`` without one
    sort per group: equi-depth bucket bounds from ``percentile_approx``, bucket
    totals (small) cumulated per group, then a window inside each bucket only."""
    if not group:  # one global order: a constant key keeps every join an equi-join
        df = df.withColumn("_g0", F.lit(0))
        return ordered_prefix(df, ["_g0"], order, value, out, buckets).drop("_g0")
    bounds = df.groupBy(*group).agg(quantile_bounds(order, buckets).alias("_bounds"))
    d = df.join(bounds, group)
    d = d.withColumn("_bk", bucket_of(order, "_bounds", buckets)).drop("_bounds")
    tot = d.groupBy(*group, "_bk").agg(F.sum(value).alias("_bsum"))
    wt = Window.partitionBy(*group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_boff", F.coalesce(F.sum("_bsum").over(wt), F.lit(0)))
    d = d.join(tot.drop("_bsum"), [*group, "_bk"])
    wi = Window.partitionBy(*group, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(out, F.col("_boff") + F.coalesce(F.sum(value).over(wi), F.lit(0))).drop("_bk", "_boff")


def auroc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """G19 AUROC = P(score+ > score-) + P(tie)/2, exact, per group.

    Pre-aggregated to distinct (group, score) counts; negatives below each score
    come from :func:`ordered_prefix`."""
    g = df.groupBy(*group, score).agg(F.sum(F.col(label).cast("bigint")).alias("_pos"),
                                      F.sum((1 - F.col(label)).cast("bigint")).alias("_neg"))
    g = ordered_prefix(g, group, score, "_neg", "_neg_below")
    contrib = F.col("_pos") * (F.col("_neg_below") + 0.5 * F.col("_neg"))
    return (g.groupBy(*group).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("n_pos"),
                                  F.sum("_neg").alias("n_neg"))
            .select(*group, "n_pos", "n_neg",
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
                    .alias("auroc")))


def answer_columns(trajectory: str) -> list[Column]:
    return [extract_answer(trajectory).alias("prediction"), extract_answer(trajectory, to_end=True).alias("prediction_to_end")]
